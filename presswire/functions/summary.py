"""Summaries of articles by a pluggable summariser."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import Settings
from ..sources.http import post

MOST_WORDS = 250
LEAST_WORDS = 150
#: Words of a stretch that counts as one sentence at most.
PIECE = 50


def chat_request(text: str, model: str) -> dict:
    """The chat call that a remote summariser would get."""
    rules = f"Summarise in one or two plain paragraphs of {LEAST_WORDS} to {MOST_WORDS} words. Write dates as DD.MM.YYYY."
    return {"model": model, "messages": [{"role": "system", "content": rules}, {"role": "user", "content": text}], "format": "json", "options": {"temperature": 0.1}}


def extractive(text: str) -> str:
    """The sentences with the most frequent words, in their order, up to MOST_WORDS words; a
    shorter text is its own summary. Of a text without sentence marks, or with sentences of over
    PIECE words, pieces of so many words count as sentences."""
    text = " ".join((text or "").split())
    if len(text.split(" ")) <= MOST_WORDS:
        return text
    sentences = []
    for s in re.findall(r"[^.!?]+[.!?]*\s*", text):
        words = s.split()
        sentences += [" ".join(words[i : i + PIECE]) for i in range(0, len(words), PIECE)]
    count = Counter(w for w in re.findall(r"\w+", text.lower()) if len(w) > 3)
    words = [re.findall(r"\w+", s.lower()) for s in sentences]
    value = [sum(count[w] for w in own) / (len(own) + 1) for own in words]
    chosen, total = set(), 0
    for i in sorted(range(len(sentences)), key=lambda i: (-value[i], i)):
        n = len(sentences[i].split())
        if total + n <= MOST_WORDS:
            chosen.add(i)
            total += n
    return " ".join(sentences[i].strip() for i in sorted(chosen))


class ChatClient:
    """A summariser that asks a chat service: a JSON request by POST, the answer's message content
    parsed by :func:`parse_answer`. Make it on the executors (``make=lambda: ChatClient(...)``)."""

    def __init__(self, settings: Settings, send: Callable[[str, bytes, dict[str, str], float], str] = post):
        self.settings, self.send = settings, send

    def __call__(self, text: str) -> str:
        s = self.settings
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {s.chat_key}"} if s.chat_key else {})
        body = json.dumps(chat_request(text, s.chat_model) | {"stream": False}).encode()
        return parse_answer(json.loads(self.send(f"{s.chat_host}/api/chat", body, headers, s.timeout))["message"]["content"])


def parse_answer(content: str) -> str:
    """The text of an answer in JSON: the member ``summary``, or else all texts in it in their order."""

    def texts(x):
        if isinstance(x, str):
            yield x
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from texts(y)

    value = json.loads(content)
    if isinstance(value, dict) and isinstance(value.get("summary"), str):
        return value["summary"]
    return "\n\n".join(texts(value))


def parse_answers(df: DataFrame, content: str = "content", to: str = "summary") -> DataFrame:
    """``df`` with the member ``summary`` of its answers in JSON in ``to``; null where there is none."""
    return df.withColumn(to, F.from_json(F.col(content), "summary string")["summary"])


def rules(summary: Column) -> Column:
    """Whether a summary keeps the rules: ``words`` (LEAST_WORDS to MOST_WORDS), ``paragraphs`` (one
    or two) and ``dates`` (no numeric date in another form than DD.MM.YYYY)."""
    words = F.size(F.filter(F.split(summary, r"\s+"), lambda w: w != ""))
    paragraphs = F.size(F.filter(F.split(summary, r"\n+"), lambda p: F.trim(p) != ""))
    other = r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b(\d\.\d{1,2}|\d{1,2}\.\d)\.\d{2,4}\b|\b\d{1,2}\.\d{1,2}\.\d{2}\b"
    return F.struct(words.between(LEAST_WORDS, MOST_WORDS).alias("words"), paragraphs.between(1, 2).alias("paragraphs"), (~summary.rlike(other)).alias("dates"))


def summarize(df: DataFrame, text: str = "content", to: str = "summary", make: Callable[[], Callable[[str], str]] = lambda: extractive) -> DataFrame:
    """``df`` with a summary of ``text``. ``make`` builds the summariser once in each task, for
    instance a client of a chat service; its failures give null summaries."""
    schema = df.drop(to).withColumn(to, df[text].cast("string")).schema
    at = df.drop(to).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summarise = make()

        def one(t):
            try:
                return summarise(t) if t is not None else None
            except Exception:
                return None

        for b in batches:
            out = [one(t) for t in b.column(b.schema.names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in at], pa.array(out, pa.string())], [*at, to])

    return df.mapInArrow(run, schema)

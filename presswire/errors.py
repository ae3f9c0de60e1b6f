"""Errors with the HTTP status that a service would answer with."""


class RequestError(Exception):
    """A request that cannot be answered."""

    status = 400

    def body(self) -> dict[str, str]:
        return {"error": str(self)}


class NoCategory(RequestError):
    status = 500


class UnknownCategories(RequestError):
    pass


class BadRequest(RequestError):
    pass


class ItemError(RequestError):
    """An item that compatible matching cannot handle."""

    status = 500


#: Why compatible matching fails on an item.
SINGLE_CATEGORY = "The only category of an item has attributes."
NUMERIC_TITLE = "The title of an item is a number."


def item_error(e: Exception) -> ItemError | None:
    """The error that a failed job stands for, if an item made it fail."""
    return next((ItemError(m) for m in (SINGLE_CATEGORY, NUMERIC_TITLE) if m in str(e)), None)

"""Where rows come from: the feed catalogue, feed XML, HTTP."""

"""Named queries over the event tables, and their SQL counterparts."""

"""All registered queries: importing this module registers them."""

from . import analytics, blend, content, dedupe, extra, feed, insight, interests, learned, lists, more, related, search, sourcing, stories, story, streams, texts  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

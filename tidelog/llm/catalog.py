"""Imports every module that registers a query."""

from __future__ import annotations

from tidelog.llm import (  # noqa: F401
    chat,
    copies,
    decontaminate,
    digest,
    language,
    lines,
    middle,
    mixing,
    quality,
    simhash,
    suffixes,
    token_links,
    url_filter,
)
from tidelog.llm.base import ORACLES, QUERIES  # noqa: F401

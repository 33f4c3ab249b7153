"""Queries over the engine tables; importing the modules registers them."""

from . import crawl, knowledge, review, streams, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "crawl", "knowledge", "review", "streams", "text"]

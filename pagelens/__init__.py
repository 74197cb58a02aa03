"""Spark-native extraction of clean text from web pages, and measures of how well it went."""

from .config import Config
from .operators.chunks import chunk
from .operators.extract import extract, extract_pages
from .operators.template import mine as mine_templates

__all__ = ["Config", "chunk", "extract", "extract_pages", "mine_templates"]

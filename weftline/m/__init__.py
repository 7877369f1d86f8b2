"""The M language: tokens, syntax tree and parser."""

from .nodes import from_json, to_json
from .parser import MSyntaxError, parse

__all__ = ["MSyntaxError", "from_json", "parse", "to_json"]

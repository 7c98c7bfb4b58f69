"""Extraction jobs by language family: ``files -> blocks``."""

from codeloom.operators.extract.cfml import cfml_blocks
from codeloom.operators.extract.html import html_blocks
from codeloom.operators.extract.java import java_blocks
from codeloom.operators.extract.jsx import jsx_blocks
from codeloom.operators.extract.sql import sql_blocks

__all__ = ["cfml_blocks", "html_blocks", "java_blocks", "jsx_blocks", "sql_blocks"]

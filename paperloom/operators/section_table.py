"""Experimental sections of line tables, as a table function that SQL can call.

    SELECT * FROM section_lines(TABLE(lines) PARTITION BY doc_id ORDER BY (k), 50, NULL)

The table has the document's id, the line's place and the line, in this order, under any names. The
result has the id under its own name and type. Lines of a document come in order, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from paperloom.operators.chunking import HEADER, OPENING, SUBSECTION


class SectionLines:
    """From an opening heading to a sub-section, or to any header more than three lines on, as experimental_sections()."""

    MOST = 10

    @staticmethod
    def analyze(lines: AnalyzeArgument, min_words: AnalyzeArgument, opening: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable or len(lines.dataType.fields) != 3 or not isinstance(lines.dataType.fields[2].dataType, StringType):
            raise ValueError("the first argument must be a table of an id, a place and a line of text")
        if not (min_words.isConstantExpression and opening.isConstantExpression):
            raise ValueError("the least number of words and the opening must be constants")
        own = lines.dataType.fields[0]
        return AnalyzeResult(StructType([StructField(own.name, own.dataType), StructField("section", IntegerType()), StructField("name", StringType()), StructField("text", StringType())]))

    def __init__(self) -> None:
        self.sub, self.header = re.compile(SUBSECTION), re.compile(HEADER)
        self.opening: list[re.Pattern] | None = None
        self.id, self.name, self.part = None, None, []
        self.n = 0

    def eval(self, row: Row, min_words: int, opening: str | None) -> Iterator[tuple]:
        if self.opening is None:
            self.opening, self.least = [re.compile(p) for p in ([opening] if opening is not None else OPENING)], min_words
        self.id, raw = row[0], row[2] or ""
        line = raw.strip()
        if self.name is not None and (self.sub.match(line) or self.header.match(line) and len(self.part) > 3):
            yield from self.closed()
        if self.name is None and any(p.search(line) for p in self.opening):
            self.name, self.part = line.strip("#").strip("*").strip(), [line]
        elif self.name is not None:
            self.part.append(raw)

    def terminate(self) -> Iterator[tuple]:
        if self.name is not None:
            yield from self.closed()

    def closed(self) -> Iterator[tuple]:
        """The section, if it is one of the first and has enough words."""
        text = "\n".join(self.part).strip()
        if self.n < self.MOST and len(text.split()) >= self.least:
            yield self.id, self.n, self.name, text
        self.n, self.name = self.n + 1, None


def register(spark: SparkSession, name: str = "section_lines") -> None:
    spark.udtf.register(name, udtf(SectionLines))

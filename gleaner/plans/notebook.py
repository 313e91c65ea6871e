"""Notebooks of search, symbol and text cells, kept as plain objects and JSON."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import intel

CELL_TYPES = ("markdown", "code", "query", "symbol", "compute")


@dataclass
class Cell:
    cell_type: str
    content: str
    language: str = ""
    cell_id: str = field(default_factory=lambda: uuid.uuid4().hex[:8])
    output: list = field(default_factory=list)


@dataclass
class Notebook:
    title: str
    author: str = ""
    tags: list[str] = field(default_factory=list)
    cells: list[Cell] = field(default_factory=list)
    notebook_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    updated_at: float = field(default_factory=time.time)

    def add(self, cell_type: str, content: str, language: str = "") -> Cell:
        if cell_type not in CELL_TYPES:
            raise ValueError(f"unknown cell type {cell_type!r}")
        self.cells.append(Cell(cell_type, content, language))
        self.updated_at = time.time()
        return self.cells[-1]

    def run(self, cell: Cell, engine) -> list:
        """Queries give ten documents, symbols their references; compute cells are refused."""
        if cell.cell_type == "query":
            cell.output = [r.asDict() for r in engine.search(cell.content, limit=10).collect()]
        elif cell.cell_type == "symbol":
            files = engine.files()
            cell.output = [r.asDict() for r in intel.find_references(cell.content, intel.references(files), intel.symbols(files)).orderBy("file_path", "line").collect()]
        elif cell.cell_type == "compute":
            raise PermissionError("compute cells are not run")
        return cell.output

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Notebook:
        data = json.loads(text)
        return cls(**data | {"cells": [Cell(**c) for c in data["cells"]]})

    def to_markdown(self) -> str:
        parts = [f"# {self.title}"]
        for c in self.cells:
            parts.append(c.content if c.cell_type == "markdown" else f"```{c.language or c.cell_type}\n{c.content}\n```")
        return "\n\n".join(parts) + "\n"


def listing(spark: SparkSession, notebooks: list[Notebook], author: str | None = None, tag: str | None = None) -> DataFrame:
    df = spark.createDataFrame(
        [(n.notebook_id, n.title, n.author, n.tags, n.updated_at, len(n.cells)) for n in notebooks],
        "notebook_id string, title string, author string, tags array<string>, updated_at double, cells int")
    if author is not None:
        df = df.filter(F.col("author") == author)
    if tag is not None:
        df = df.filter(F.array_contains("tags", tag))
    return df.orderBy(F.desc("updated_at"), "notebook_id")

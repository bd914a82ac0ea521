"""Tools: functions with a schema, registered for SQL, that give errors as values."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.chunking import pack


@dataclass(frozen=True)
class Tool:
    """name, what it does, the JSON schema of its arguments, and the function of them."""

    name: str
    description: str
    parameters: dict
    run: Callable[..., object]


class Tools:
    """A registry. A call never raises: it gives a result or an error."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def add(self, tool: Tool) -> None:
        self._tools[tool.name] = tool

    def call(self, name: str, arguments: str) -> tuple[str | None, str | None]:
        if name not in self._tools:
            return None, f"unknown tool: {name}"
        try:
            return json.dumps(self._tools[name].run(**json.loads(arguments or "{}")), ensure_ascii=False, sort_keys=True), None
        except Exception as error:  # the row says what went wrong
            return None, f"{type(error).__name__}: {error}"

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.description, json.dumps(t.parameters, sort_keys=True)) for t in self._tools.values()]
        return spark.createDataFrame(rows, "name string, description string, parameters string")

    def apply(self, calls: DataFrame, name: str = "name", arguments: str = "arguments") -> DataFrame:
        """calls with result and error of each."""
        run = self.call

        @F.pandas_udf("result string, error string")
        def called(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([run(n, t) for n, t in zip(names, texts, strict=True)], columns=["result", "error"])

        return calls.withColumn("_", called(name, arguments)).select(*calls.columns, "_.result", "_.error")


def openai_form(name: str, description: str, parameters: dict[str, str]) -> dict:
    """A tool (its parameters with their descriptions) in the form that models take: integers
    are known by top_k in the name or number in the description, all else is a string."""
    kind = lambda p, d: "integer" if "top_k" in p or "number" in d.lower() else "string"
    properties = {p: {"type": kind(p, d), "description": d} for p, d in parameters.items()}
    return {"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": properties, "required": list(parameters)}}}


def register_split(spark: SparkSession, name: str = "split_text") -> None:
    """The packing splitter as a table function of SQL: split_text(text) gives idx, content."""

    @F.udtf(returnType="idx int, content string")
    class Split:
        def eval(self, text: str):
            yield from enumerate(pack(text or ""))

    spark.udtf.register(name, Split)


def embed_stub(dimensions: int = 64) -> Callable:
    """Stands for an embedding model: unit vectors drawn from the words of a text. A real one
    is a function of the same type."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            out = np.zeros(dimensions)
            for word in (text or "").lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                out[int.from_bytes(h[:4], "big") % dimensions] += 1 if h[4] & 1 else -1
            return (out / max(np.linalg.norm(out), 1e-8)).tolist()

        return texts.map(one)

    return embed

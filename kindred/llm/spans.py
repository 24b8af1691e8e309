"""Shared shape of the span finders: kinds with code-point spans, counted and digested per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.textarrow import blocks, strings
from kindred.runtime import ship

Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, finder: Callable[[], Callable[[str], tuple[list[Span], list[Span], str]]], counted: tuple[str, ...], keep: tuple[str, ...] = (), text_out: bool = False, cues: str | None = None) -> DataFrame:
    """doc_id, a count per base kind, base and all spans as strings; with text_out also the rewritten text, and the columns to keep as _k0, _k1 and so on, whatever their names.

    finder() makes, once per task, a function from a text to (base spans, all spans, new text). A text that holds none of
    the cues (a pattern for Arrow) has no spans, and is not looked at one by one.
    """
    ship(docs.sparkSession)
    others = [(f"_k{i}", docs.schema[name].dataType) for i, name in enumerate(keep)]
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{name}`").alias(f"_k{i}") for i, name in enumerate(keep))]
    fields = ["doc_id long", *(f"n_{k} long" for k in counted), "base string", "spans string", *(["text string"] if text_out else []), *(f"{name} {kind.simpleString()}" for name, kind in others)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for table in blocks(batches, 8_000_000):
            counts: list[list[int]] = [[] for _ in counted]
            base_out, all_out, new = [], [], []
            nulls = table.column("text").is_null().to_pylist()
            texts = strings(table)
            maybe = pc.match_substring_regex(texts, cues).to_pylist() if cues else [True] * len(texts)
            for text, null, look in zip(texts.to_pylist() if text_out else pc.if_else(pa.array(maybe, pa.bool_()), texts, "").to_pylist(), nulls, maybe):
                base, spans, rewritten = find(text) if look else ([], [], text)
                for k, name in enumerate(counted):
                    counts[k].append(sum(s[0] == name for s in base) if base else 0)
                base_out.append(joined(base))
                all_out.append(joined(spans))
                if text_out:
                    new.append(None if null else rewritten)
            arrays = [table.column("doc_id").combine_chunks(), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_out, pa.string()), pa.array(all_out, pa.string())]
            if text_out:
                arrays.append(pa.array(new, pa.string()))
            arrays += [table.column(name).combine_chunks() for name, _ in others]
            names = ["doc_id", *(f"n_{k}" for k in counted), "base", "spans", *(["text"] if text_out else []), *(name for name, _ in others)]
            yield from pa.table(dict(zip(names, arrays))).to_batches()

    return docs.select(*columns).mapInArrow(run, ", ".join(fields))

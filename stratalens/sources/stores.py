"""JSON stores of projects: the knowledge graph's nodes, references and file times, and the cache of answers.

A store is one JSON object a project, maps by question at its first level. Readers turn any number of them (store, content) into
tables and fill in what an entry leaves out; a file that isn't JSON has no rows. Writers make a project's store of the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The layout of a graph's store, and what is taken where an entry lacks a field.
NODE = {"question": ("string", ""), "normalized_question": ("string", ""), "intent": ("string", ""), "created_at": ("string", ""), "last_accessed": ("string", ""), "access_count": ("bigint", 0), "confidence": ("double", 1.0)}
REFERENCES = {
    "code_refs": {"file_path": ("string", ""), "line_start": ("bigint", 0), "line_end": ("bigint", 0), "symbol": ("string", ""), "relevance": ("double", 1.0)},
    "test_refs": {"test_file": ("string", ""), "test_name": ("string", ""), "test_type": ("string", "unit")},
    "doc_refs": {"doc_file": ("string", ""), "section": ("string", ""), "doc_type": ("string", "markdown")},
}


def _struct(fields: dict) -> str:
    return "struct<" + ", ".join(f"{name}: {kind}" for name, (kind, _) in fields.items()) + ">"


_SCHEMA = ", ".join([f"qa_nodes map<string, {_struct(NODE)}>", *[f"{name} map<string, array<{_struct(fields)}>>" for name, fields in REFERENCES.items()], "file_mtimes map<string, double>"])


def _filled(fields: dict, of: str) -> list:
    return [F.coalesce(f"{of}.{name}", F.lit(default).cast(kind)).alias(name) for name, (kind, default) in fields.items()]


def read_graph(stores: DataFrame) -> dict[str, DataFrame]:
    """The tables of graph stores (store, content): qa_nodes (store, qa_id, fields), code_refs, test_refs and doc_refs (store, qa_id, position,
    fields) and file_mtimes (store, file_path, mtime)."""
    parsed = stores.select("store", F.from_json("content", _SCHEMA).alias("g"))
    out = {"qa_nodes": parsed.select("store", F.explode("g.qa_nodes").alias("qa_id", "n")).select("store", "qa_id", *_filled(NODE, "n"))}
    for name, fields in REFERENCES.items():
        each = parsed.select("store", F.explode(f"g.{name}").alias("qa_id", "refs")).select("store", "qa_id", F.posexplode("refs").alias("position", "r"))
        out[name] = each.select("store", "qa_id", "position", *_filled(fields, "r"))
    out["file_mtimes"] = parsed.select("store", F.explode("g.file_mtimes").alias("file_path", "mtime"))
    return out


def write_graph(tables: dict[str, DataFrame]) -> DataFrame:
    """Stores (store, content) of such tables; missing tables are empty maps. A store is its project's, so a row holds one project's graph."""
    maps = None
    for name, rows in tables.items():
        fields = NODE if name == "qa_nodes" else REFERENCES.get(name)
        if name == "file_mtimes":
            by = rows.groupBy("store").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("file_path", "mtime")))).alias(name))
        elif name == "qa_nodes":
            by = rows.groupBy("store").agg(F.map_from_entries(F.collect_list(F.struct("qa_id", F.struct(*fields)))).alias(name))
        else:
            refs = rows.groupBy("store", "qa_id").agg(F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("r")))).alias("each"))
            by = refs.groupBy("store").agg(F.map_from_entries(F.collect_list(F.struct("qa_id", F.transform("each", lambda x: x["r"])))).alias(name))
        maps = by if maps is None else maps.join(by, "store", "full_outer")
    return maps.select("store", F.to_json(F.struct(F.lit("1.0").alias("version"), *tables)).alias("content"))


def reverse_references(code_refs: DataFrame) -> DataFrame:
    """Which questions a file or symbol leads back to: kind (file, symbol), name, qa_id, each once; empty symbols aren't any."""
    files = code_refs.select("store", F.lit("file").alias("kind"), F.col("file_path").alias("name"), "qa_id")
    symbols = code_refs.filter("symbol <> ''").select("store", F.lit("symbol").alias("kind"), F.col("symbol").alias("name"), "qa_id")
    return files.unionByName(symbols).distinct()

"""The audit journal: events written in batches, one of them twice, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import journal as J
from stratalens.registry import query
from stratalens.sources.staging import shared_folder
from stratalens.sources.tables import AUDIT_SQL, audit, table

LEVELS = ("INFO", "WARNING", "ERROR")
ENTRY = "event_id long, ts timestamp_ntz, user_id long, operation string, level string, success boolean, ref int, value double"


def _journal(spark, sf_dir) -> str:
    rows = audit(table(spark, sf_dir, "events"))
    path = shared_folder(spark, "journal")
    for batch, level in enumerate(LEVELS):
        for _ in range(2):  # every batch is run again, as after a loss
            J.append(rows.filter(F.col("level") == level), path, batch)
    # Lines that aren't entries, in a batch of their own.
    broken = table(spark, sf_dir, "documents").filter("text like '%{%' or doc_id < 5").select(F.substring(F.regexp_replace("text", "[\r\n]+", " "), 1, 200).alias("line"))
    folder = f"lines/{len(LEVELS):020d}-{'0' * 32}"
    broken.write.text(f"{path}/{folder}")
    J.put(spark, f"{path}/commits/{len(LEVELS):020d}.json", f'{{"batch": {len(LEVELS)}, "folder": "{folder}", "bytes": 0}}')
    return path


@query(f"SELECT CASE level WHEN 'INFO' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END AS batch, event_id, ts, user_id, operation, level, success, ref, value FROM {AUDIT_SQL}")
def q_audit_journal(spark, sf_dir):
    """All entries once, though every batch was written twice and one holds other lines."""
    return J.read(spark, _journal(spark, sf_dir), ENTRY)[0]


@query("SELECT 3 AS batch, left(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), 200) AS line FROM documents WHERE (contains(text, '{') OR doc_id < 5) AND length(trim(left(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), 200))) > 0")
def q_journal_bad_lines(spark, sf_dir):
    """Lines of the journal that aren't entries."""
    return J.read(spark, _journal(spark, sf_dir), ENTRY)[1]

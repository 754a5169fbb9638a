"""Writers: CSV, the fixed curated schema, JSON summaries, Markdown tables, fold checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURATED = (
    "record_key string, source_id string, source_file string, source_row bigint, ticker string, event_date date, company string, call_year int, call_quarter int, transcript string, "
    "structured_content string, transcript_chars bigint, transcript_words bigint, text_hash string, has_qa_section int, analyst_question_count int, quality_score bigint, soft_quality_flags string"
)
#: What a finished fold holds.
FOLD_ARTIFACTS = ("train_calls", "val_calls", "test_calls", "train_pairs", "val_pairs", "test_pairs", "pair_predictions", "call_predictions", "fold_metrics", "fold_config")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one file only at the edge of a report. Arrays become pipe-joined text."""
    flat = df.select(*[F.array_join(c, "|").alias(c) if kind == "array<string>" else F.col(c) for c, kind in df.dtypes])
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").option("header", True).csv(path)


def write_curated(records: DataFrame, decisions: DataFrame, keep: str, path: str) -> bool:
    """The kept records in the fixed schema; False, with nothing written, if none is kept."""
    kept = records.join(decisions.where(keep).select("record_key", *[c for c in ("transcript_chars", "transcript_words", "text_hash", "has_qa_section", "analyst_question_count", "quality_score", "soft_quality_flags") if c in decisions.columns]), "record_key")
    out = []
    for f in (x.strip().split(" ") for x in CURATED.split(",")):
        c = F.to_json(f[0]) if f[0] == "structured_content" and dict(kept.dtypes).get(f[0], "").startswith("array") else F.col(f[0]) if f[0] in kept.columns else F.lit(None)
        out.append(c.try_cast(f[1]).alias(f[0]) if f[0] in kept.columns else c.cast(f[1]).alias(f[0]))
    done = kept.select(*out)
    if done.isEmpty():
        return False
    done.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return True


def json_summary(one_row: DataFrame) -> str:
    """A one-row frame as a JSON object."""
    return json.dumps(json.loads(one_row.toJSON().first()), indent=2, sort_keys=True)


def markdown_table(df: DataFrame, limit: int = 25) -> str:
    """A small table for a report: the first ``limit`` rows as they are ordered."""
    fmt = lambda v: "nan" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = df.limit(limit).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(fmt(v) for v in r) + " |" for r in rows)])


def interval(value: float | None, lower: float | None, upper: float | None) -> str:
    f = lambda v: "nan" if v is None else f"{v:.4f}"
    return f"{f(value)} [{f(lower)}, {f(upper)}]"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fold_complete(spark: SparkSession, root: str, fold: int) -> bool:
    """Whether every artifact of a fold was written to the end."""
    return all(_exists(spark, f"{root}/fold={fold}/{a}/_SUCCESS") for a in FOLD_ARTIFACTS)


def write_fold(artifacts: dict[str, DataFrame], root: str, fold: int) -> None:
    """A fold's artifacts, each a Parquet folder; a resumed run skips complete folds."""
    if missing := set(FOLD_ARTIFACTS) - set(artifacts):
        raise ValueError(f"missing artifacts: {sorted(missing)}")
    for name, df in artifacts.items():
        df.write.mode("overwrite").parquet(f"{root}/fold={fold}/{name}")

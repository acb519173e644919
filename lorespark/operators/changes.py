"""Change detection, publication and lifecycle over snapshots of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACY_SECONDS, BASE_SECONDS, CAP_SECONDS, ATTEMPTS = 2.0, 2.0, 300.0, 5
VERSIONS = ["parser_version", "chunker_version", "converter_version", "embedding_model_id", "embedding_text_version"]


def stat_unchanged(size: Column, mtime: Column, old_size: Column, old_mtime: Column) -> Column:
    return (size == old_size) & (F.abs(mtime - old_mtime) < 1e-6)


def racy(mtime: Column, indexed_at: Column) -> Column:
    """Too near to the last indexing for equal times to prove anything."""
    return F.coalesce(F.abs(indexed_at - mtime) < RACY_SECONDS, F.lit(False))


def moves(new: DataFrame, gone: DataFrame) -> DataFrame:
    """(rel_path, old_path): new files whose content exactly one vanished file of the same kind had; one new file a vanished one, the first by path."""
    one = Window.partitionBy("content_hash", "kind")
    left = gone.withColumn("n", F.count("*").over(one)).where("n = 1").select("content_hash", "kind", F.col("rel_path").alias("old_path"))
    first = new.withColumn("k", F.row_number().over(one.orderBy("rel_path"))).where("k = 1")
    return first.join(left, ["content_hash", "kind"]).select("rel_path", "old_path")


def diff(scan: DataFrame, baseline: DataFrame, complete: bool = True) -> DataFrame:
    """(rel_path, old_path, decision) of each path of a scan and its baseline, both (rel_path, size, mtime, content_hash, kind) and the baseline optionally indexed_at.

    new, changed, unchanged, unchanged_restat (touched, same content), moved, deleted - or unseen if the scan was
    incomplete, when nothing is ever taken for deleted.  One full outer join; renames are found among what it leaves single.
    """
    old = baseline.select("rel_path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("content_hash").alias("old_hash"), F.col("kind").alias("old_kind"), (F.col("indexed_at") if "indexed_at" in baseline.columns else F.lit(None).cast("double")).alias("indexed_at"))
    both = scan.join(old, "rel_path", "full")
    new = both.where("old_hash is null").select("rel_path", "content_hash", "kind")
    gone = both.where("content_hash is null").select("rel_path", F.col("old_hash").alias("content_hash"), F.col("old_kind").alias("kind"))
    renamed = moves(new, gone) if complete else new.where("false").select("rel_path", F.lit(None).cast("string").alias("old_path"))
    same = stat_unchanged(F.col("size"), F.col("mtime"), F.col("old_size"), F.col("old_mtime")) & ~racy(F.col("mtime"), F.col("indexed_at"))
    stayed = both.where("content_hash is not null and old_hash is not null").select("rel_path", F.lit(None).cast("string").alias("old_path"), F.when(same, "unchanged").when(F.col("content_hash") == F.col("old_hash"), "unchanged_restat").otherwise("changed").alias("decision"))
    added = new.join(renamed, "rel_path", "left").select("rel_path", "old_path", F.when(F.col("old_path").isNull(), "new").otherwise("moved").alias("decision"))
    lost = gone.join(renamed.select(F.col("old_path").alias("rel_path")), "rel_path", "left_anti").select("rel_path", F.lit(None).cast("string").alias("old_path"), F.lit("deleted" if complete else "unseen").alias("decision"))
    return stayed.unionByName(added).unionByName(lost)


def counts(decisions: DataFrame) -> DataFrame:
    names = ["new", "changed", "unchanged", "unchanged_restat", "moved", "unseen", "deleted"]
    return decisions.agg(*(F.count_if(F.col("decision") == n).alias(n) for n in names), F.count_if(F.col("decision").isin("new", "changed", "moved")).alias("to_process"))


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that appeared, went or have another size or time, of two (rel_path, size, mtime) snapshots."""
    a = before.select("rel_path", F.struct("size", "mtime").alias("a"))
    b = after.select("rel_path", F.struct("size", "mtime").alias("b"))
    return a.join(b, "rel_path", "full").where(~F.equal_null("a", "b")).select("rel_path")


def backoff(attempts: Column) -> Column:
    """Seconds before the next attempt; null once there were too many."""
    return F.when(attempts < ATTEMPTS, F.least(BASE_SECONDS * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1), F.lit(CAP_SECONDS)))


def rebuild_plan(states: DataFrame) -> DataFrame:
    """(source_id, mode, reason) from (source_id, build_state, rebuild_reason, active_build_id, built struct, current struct)."""
    differing = F.concat_ws(", ", *(F.when(~F.equal_null(f"built.{v}", f"current.{v}"), v) for v in VERSIONS))
    none = F.col("active_build_id").isNull()
    reason = (
        F.when(F.col("build_state") == "needs_full_rebuild", F.coalesce("rebuild_reason", F.lit("needs_full_rebuild")))
        .when((F.col("build_state").isin("building", "failed") & none) | none | F.col("built").isNull(), "no published build")
        .when(differing != "", F.concat(F.lit("versions changed: "), differing))
    )
    return states.select("source_id", F.when(reason.isNull(), "incremental").otherwise("full").alias("mode"), reason.alias("reason"))


def claim(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The n due jobs to run next: highest priority, then oldest, then by id."""
    return jobs.where((F.col("status") == "queued") & (F.col("next_attempt_at") <= now)).orderBy(F.desc("priority"), "created_at", "id").limit(n)


def visible(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of published builds only: (source_id, build_id) as the manifest has them."""
    return rows.join(active, ["source_id", "build_id"], "left_semi")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of equal keys."""
    return table.join(rows.select(keys).distinct(), keys, "left_anti").unionByName(rows)


def keep_first(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows are added where their keys are new."""
    return table.unionByName(rows.join(table.select(keys).distinct(), keys, "left_anti"))


def carry_forward(edges: DataFrame, links: DataFrame, files: DataFrame, entities: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose file is still there, and links whose entity and document are, each once."""
    e = edges.join(files.select("file_id"), "file_id", "left_semi").dropDuplicates(["id"])
    l = links.join(entities.select("entity_id"), "entity_id", "left_semi").join(documents.select("document_id"), "document_id", "left_semi").dropDuplicates(["entity_id", "document_id"])
    return e, l


def stale(vectors: DataFrame, subjects: DataFrame, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(vectors of another model, subjects with text but no vector of this one)."""
    return vectors.where(F.col("fingerprint") != fingerprint), subjects.where(F.trim("text") != "").join(vectors.where(F.col("fingerprint") == fingerprint), "id", "left_anti")


def graph_plan(states: DataFrame) -> DataFrame:
    """(source_id, action, reason, full) from (source_id, state, base_build_id, build_id, base_generation, generation, base_derivation, derivation, base_digest, digest, manifest_ok)."""
    same_rows = F.equal_null("base_build_id", "build_id")
    same_derivation = F.equal_null("base_derivation", "derivation")
    same_digest = F.equal_null("base_digest", "digest")
    complete = same_rows & same_derivation & F.col("manifest_ok")
    retry = F.col("state").isin("failed", "stale", "building")
    skip = (F.col("state") == "ready") & F.equal_null("base_generation", "generation") & same_derivation & same_digest
    why = F.when(F.col("base_build_id").isNull(), "first_build").when(~same_derivation, "derivation_changed").when(~same_rows, "base_rebuilt").otherwise("metadata_missing")
    action = F.when(skip, "skip").when(complete & same_digest, "rebind").when(retry, "retry").when(~complete, "full").otherwise("incremental")
    reason = F.when(skip, "current").when(complete & same_digest, "equivalent_snapshot").when(~complete, why).when(retry, "retry_after_failure").otherwise("files_changed")
    return states.select("source_id", action.alias("action"), reason.alias("reason"), (~skip & ~complete).alias("full"))


def symmetric_difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are on one side only or whose value differs."""
    return before.select(key, F.col(value).alias("a")).join(after.select(key, F.col(value).alias("b")), key, "full").where(~F.equal_null("a", "b")).select(key)

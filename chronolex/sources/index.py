"""The inverted index as segments: grows by whole segments, forgets by tombstones, merges a few segments at a time.

A segment has three tables. ``vectors``: one row per chunk with its terms.
``blocks``: runs of at most BLOCK postings of one term and decade by falling
impact, with the run's greatest impact and least year, in folders by tier
(whether the greatest impact is high) and by a hash bucket of the term. ``terms``: how many
chunks have a term, and how often. A tombstone lists chunks of segments and what
they take from the terms, so that statistics are always those of the living.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG
from .snapshots import Conflict, Snapshots, State

BLOCK = 128
BUCKETS = 64
ERA = 10
"""Years that may stand in one block, so that the least of them tells something."""

HIGH = 0.6
"""Share of the greatest possible impact from which a block is of tier 0."""

FAN_IN = 4
VECTORS = "chunk_id string, doc_id long, decision_year int, dl long, terms array<struct<term: string, tf: long>>"
ENTRY = "chunk_id: string, doc_id: bigint, decision_year: int, dl: bigint, tf: bigint"
ROWS = f"term string, block string, n int, impact double, min_year int, entries array<struct<{ENTRY}>>"
BLOCKS = f"{ROWS}, tier int, bucket int"
TERMS = "term string, df long, cf long"
DEAD = "segment string, chunk_id string"
LOST = "segment string, term string, df long, cf long"
NO_YEAR = 1 << 30


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term adds to a BM25 score, before its weight."""
    return tf * (CONFIG.k1 + 1) / (tf + CONFIG.k1 * (1 - CONFIG.b + CONFIG.b * dl / avgdl))


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings_of(vectors: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, decision_year, dl, tf, and other columns of ``vectors``)."""
    rest = [c for c in vectors.columns if c != "terms"]
    return vectors.select(*rest, F.explode("terms").alias("_t")).select("_t.term", *rest, "_t.tf")


def _block_rows():
    """Sorted postings of a partition as blocks; a local function, so that workers need not import this package."""
    fields = ["chunk_id", "doc_id", "decision_year", "dl", "tf"]
    most, no_year, era = BLOCK, NO_YEAR, ERA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            term, year = b.column("term"), np.asarray(pc.fill_null(b.column("decision_year"), no_year))
            new = np.ones(b.num_rows, bool)
            new[1:] = np.asarray(pc.not_equal(term.slice(1), term.slice(0, b.num_rows - 1))) | (year[1:] // era != year[:-1] // era)
            first = np.flatnonzero(new)
            place = np.arange(b.num_rows) - first[np.cumsum(new) - 1]
            at = np.flatnonzero(place % most == 0)
            ends = np.append(at[1:], b.num_rows)
            least = np.minimum.reduceat(year, at)
            own = pa.StructArray.from_arrays([b.column(c) for c in fields], fields)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [term.take(take), b.column("chunk_id").take(take), pa.array(ends - at, pa.int32()), pa.array(np.maximum.reduceat(np.asarray(b.column("impact")), at)), pa.array(least, pa.int32(), mask=least == no_year),
                 pa.ListArray.from_arrays(pa.array(np.append(at, b.num_rows), pa.int32()), own), b.column("tier").take(take), b.column("bucket").take(take)],
                ["term", "block", "n", "impact", "min_year", "entries", "tier", "bucket"],
            )

    return run


class Index:
    """An index in a folder, in the state that it had when it was opened or last changed."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.kept = spark, Snapshots(spark, folder)
        self.state: State = self.kept.state()
        self.buckets = self.state.facts.get("buckets", buckets)

    # --- reading -----------------------------------------------------------------

    @property
    def segments(self) -> list[dict]:
        return self.state.entries("vectors")

    def _live(self) -> list[str]:
        return [s["segment"] for s in self.segments]

    def _tagged(self, table: str, schema: str) -> DataFrame:
        """A table of all segments, each row with its segment and the mean length that its impacts were computed with."""
        parts = [self.kept.read([e], schema).withColumn("segment", F.lit(e["segment"])).withColumn("built_with", F.lit(e["avgdl"])) for e in self.state.entries(table)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, segment string, built_with double")

    def dead(self) -> DataFrame:
        """(segment, chunk_id) of chunks that were deleted or replaced and whose segment is still there."""
        return self.kept.read(self.state.entries("dead"), DEAD).filter(F.col("segment").isin(self._live()))

    def alive(self, rows: DataFrame) -> DataFrame:
        """``rows`` with (segment, chunk_id) but those of dead chunks."""
        return rows.join(self.dead(), ["segment", "chunk_id"], "left_anti") if self.state.entries("dead") else rows

    def blocks(self) -> DataFrame:
        """Blocks with ``segment`` and ``built_with``. They may hold entries of dead chunks; their bounds hold all the same."""
        return self._tagged("blocks", BLOCKS)

    def vectors(self) -> DataFrame:
        return self.alive(self._tagged("vectors", VECTORS)).drop("built_with")

    def postings(self) -> DataFrame:
        """(term, chunk_id, doc_id, decision_year, dl, tf) of living chunks."""
        return postings_of(self.vectors().drop("segment"))

    def terms(self) -> DataFrame:
        """(term, df, cf) over living chunks."""
        known = self.kept.read(self.state.entries("terms"), TERMS)
        if self.state.entries("lost"):
            lost = self.kept.read(self.state.entries("lost"), LOST).filter(F.col("segment").isin(self._live()))
            known = known.unionByName(lost.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
        elif len(self.segments) == 1:
            return known
        return known.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")

    def size(self) -> tuple[int, float]:
        """Number and mean length of living chunks."""
        live = self._live()
        lost = [x for e in self.state.entries("dead") for x in e["counts"] if x["segment"] in live]
        n = sum(s["n"] for s in self.segments) - sum(x["n"] for x in lost)
        total = sum(s["total"] for s in self.segments) - sum(x["total"] for x in lost)
        return n, total / n if n else 0.0

    def size_table(self) -> DataFrame:
        return self.spark.createDataFrame([self.size()], "n_all long, avgdl double")

    # --- changing ----------------------------------------------------------------

    def _segment(self, vectors: DataFrame) -> dict[str, dict]:
        """Write a segment: an entry for each of its tables."""
        folder = self.kept.write(vectors.select([c.split()[0] for c in VECTORS.split(", ", 4)]), "vectors")
        kept = self.kept.read([{"folder": folder}], VECTORS)
        n, total = kept.agg(F.count("*"), F.sum("dl")).first()
        name, avgdl = folder.split("/")[1], (total or 0) / n if n else 0.0
        weighed = postings_of(kept).withColumn("impact", impact(F.col("tf"), F.col("dl"), F.lit(avgdl or 1.0)))
        placed = weighed.withColumn("tier", (F.col("impact") < HIGH * (CONFIG.k1 + 1)).cast("int")).withColumn("bucket", bucket(F.col("term"), self.buckets))
        # chunks of a term that many have lie in several ranges, so no task holds a whole term
        order = ["tier", "bucket", "term", F.floor(F.coalesce("decision_year", F.lit(NO_YEAR)) / ERA), F.desc("impact"), "chunk_id"]
        dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        blocks = self.kept.write(dealt.mapInArrow(_block_rows(), BLOCKS), "blocks", "tier", "bucket")
        terms = self.kept.write(postings_of(kept).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "terms")
        facts = {"segment": name, "avgdl": avgdl or 1.0, "n": n, "total": total or 0}
        return {"vectors": {"folder": folder, **facts}, "blocks": {"folder": blocks, **facts}, "terms": {"folder": terms, **facts}}

    def _tombstone(self, ids: DataFrame) -> dict[str, dict] | None:
        """Write the living chunks among ``ids`` as dead, and what the terms lose by them; None if there are none."""
        hit = self.vectors().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
        dead = self.kept.write(hit.select("segment", "chunk_id", "dl"), "dead")
        counts = self.kept.read([{"folder": dead}], DEAD + ", dl long").groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()  # a row per segment
        if not counts:
            return None
        lost = self.kept.write(postings_of(hit).groupBy("segment", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "lost")
        names = [c["segment"] for c in counts]
        return {"dead": {"folder": dead, "segments": names, "counts": [c.asDict() for c in counts]}, "lost": {"folder": lost, "segments": names}}

    def _commit(self, new: dict[str, list[dict]], without: tuple[str, ...] = ()) -> None:
        """Add entries, and leave out segments and the tombstones that only they had. The data was derived from this state, so no other may have come."""
        base = self.state

        def change(s: State) -> State:
            if s.version != base.version:
                raise Conflict(f"{self.kept.folder} has changed since it was opened")
            tables = {t: [e for e in s.entries(t) if not (set(e.get("segments", [e.get("segment")])) <= set(without))] for t in ("vectors", "blocks", "terms", "dead", "lost")}
            return s.but(facts={"buckets": self.buckets}, **{t: [*es, *new.get(t, [])] for t, es in tables.items()})

        self.state = self.kept.commit(change)

    def add(self, vectors: DataFrame) -> None:
        """Chunks as a new segment. A chunk whose id is in the index replaces it."""
        new = {t: [e] for t, e in self._segment(vectors).items()}
        if self.segments:
            gone = self._tombstone(self.kept.read(new["vectors"], VECTORS))
            new |= {t: [e] for t, e in (gone or {}).items()}
        self._commit(new)

    def delete(self, ids: DataFrame) -> None:
        """Forget chunks by ``chunk_id``; ids that are not there change nothing."""
        gone = self._tombstone(ids)
        if gone:
            self._commit({t: [e] for t, e in gone.items()})

    def merge(self) -> bool:
        """Replace FAN_IN segments of about one size, the smallest such, by one without their dead; False if there are none."""
        tiers: dict[int, list[dict]] = {}
        for s in self.segments:
            tiers.setdefault(max(s["n"], 1).bit_length() // FAN_IN.bit_length(), []).append(s)
        ready = [tiers[k][:FAN_IN] for k in sorted(tiers) if len(tiers[k]) >= FAN_IN]
        if not ready:
            return False
        names = tuple(s["segment"] for s in ready[0])
        live = self.vectors().filter(F.col("segment").isin(list(names)))
        self._commit({t: [e] for t, e in self._segment(live.drop("segment")).items()}, names)
        return True

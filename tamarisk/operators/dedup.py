"""Duplicate customers: exact birth-date blocks, scored by their least similar pair of names.

Nothing here depends on how the rows are spread over birth dates. Members stay in exploded
form (one row per member) and are never collected into an array. Names are first reduced to
the distinct sorted-token names of a block, with a map-side combine, so copies cost nothing.
Short blocks are scored as one bounded list each. In a long block every name is first compared
with the block's few shortest and longest ones, which gives a score to beat; a block whose score is
0 is done. Then names are bounded from below by signatures. What all names of a block begin with is
common to any two of them. Behind it, two names of several words share the blank, one character more if
their first words have a common letter, and one more if the rest has; other names share one if they
have a common letter at all. So letters and lengths bound a pair's score without comparing it. Names
are grouped by the most frequent of their letters, whose sets are few whatever the number of names; two
groups are out when even their longest names are not bounded below the score to beat, which the longest names
of all groups have lowered among themselves before. Names of the groups that
remain meet in cells, by all of their letters first, and only pairs that could still be lower are scored,
the lowest bounds first. Every name that is left out has a bound that says why.

Where the signatures spare less than half of a block's pairs, its names are cut into chunks and all chunk pairs
are scored. No pair is ever a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.functions.ordered import numbered
from tamarisk.functions.similarity import groups_to_meet, min_ratio_in, min_ratio_to, score_cell, score_chunk_pair, score_probe, sorted_tokens
from tamarisk.operators import roles
from tamarisk.session import materialise

BLOCK = ["dataset", "dob"]
SHORT_BLOCK = 256   # names that are scored as one list
PIVOTS = 6
CHUNK_NAMES = 2048
MOST_CHUNKS = 1024  # a longer block gets longer chunks: a name is sent this many times at most
LETTERS = 60        # the most frequent ones, which a signature knows
GROUP_LETTERS = 6   # the most frequent of these, by which names are grouped
PROBES = 4          # names of a group that look for a lower score to beat
MOST_PROBES = 4096  # of a block; they bear on the work only, not on the score


def candidates(df: DataFrame) -> DataFrame:
    """Rows in the roles detection needs; ``df`` has dataset, row_pos and business columns."""
    r = roles.dedup_roles(df.columns)
    if not (r["dob"] and r["name"]):
        raise ValueError("duplicate detection needs a date-of-birth and a name column")
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    row_id = text(r["id"]) if r["id"] else F.col("row_pos").cast("string")
    return df.select("dataset", row_id.alias("row_id"), "row_pos", text(r["name"]).alias("name"),
                     text(r["dob"]).alias("dob"), text(r["phone"]).alias("phone")).where("dob <> ''")


def block_names(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*BLOCK, sorted_tokens(F.col("name")).alias("sorted_name")).agg(
        F.count("*").alias("n"), F.min("row_pos").alias("first_pos"))


def blocks(names: DataFrame) -> DataFrame:
    return names.groupBy(*BLOCK).agg(F.sum("n").alias("size"), F.count("*").alias("n_names"),
                                     F.min("first_pos").alias("first_pos")).where("size > 1")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys over all partitions: small rows whose scoring takes long must not be packed into one task by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _short_scores(names: DataFrame, found: DataFrame) -> DataFrame:
    short = found.where(F.col("n_names").between(2, SHORT_BLOCK)).select(*BLOCK)
    lists = _spread(names.join(short, BLOCK).select(*BLOCK, "sorted_name"), *BLOCK).groupBy(*BLOCK).agg(F.collect_list("sorted_name").alias("names"))
    return lists.select(*BLOCK, min_ratio_in("names").alias("score"))


def _pivot_scores(inside: DataFrame) -> DataFrame:
    """An upper bound of each long block's score: the lowest of all its names against its shortest and longest ones."""
    place = lambda order: F.row_number().over(W.partitionBy(*BLOCK).orderBy(order, "sorted_name"))
    ends = [inside.withColumn("_n", place(order)).where(F.col("_n") <= PIVOTS) for order in (F.asc("len"), F.desc("len"))]  # cut before the shuffle
    pivots = ends[0].unionByName(ends[1]).groupBy(*BLOCK).agg(F.sort_array(F.collect_set("sorted_name")).alias("pivots"))
    return _spread(inside.join(pivots, BLOCK), *BLOCK, "sorted_name").select(*BLOCK, min_ratio_to("sorted_name", "pivots").alias("score")).groupBy(*BLOCK).agg(F.min("score").alias("score"))


def _signatures(inside: DataFrame, bounds: DataFrame) -> DataFrame:
    """Names with the letters of their first word and of the rest, behind what all names of their block begin with."""
    letters = (inside.select(F.explode(F.split("sorted_name", "")).alias("c")).where("c NOT IN ('', ' ')")
               .groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(LETTERS).collect())
    held = lambda text: reduce(lambda x, y: x.bitwiseOR(y), [
        F.when(F.contains(text, F.lit(r.c)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(letters)], F.lit(0).cast("long"))
    ends = inside.groupBy(*BLOCK).agg(F.min("sorted_name").alias("a"), F.max("sorted_name").alias("z"))
    longest = F.least(F.char_length("a"), F.char_length("z"), F.lit(256))
    common = F.size(F.filter(F.sequence(F.lit(0), longest), lambda i: F.substr("a", F.lit(1), i) == F.substr("z", F.lit(1), i))) - 1
    known = ends.select(*BLOCK, common.alias("shared")).join(bounds, BLOCK)
    tail = F.substr("sorted_name", F.col("shared") + 1)
    placed = inside.join(known, BLOCK).withColumn("tail", tail)
    first = F.substring_index("tail", " ", 1)
    placed = placed.select(*BLOCK, "sorted_name", "len", "shared", "score", F.contains("tail", F.lit(" ")).alias("words"),
                           held(first).alias("m1"), held(F.substr("tail", F.char_length(first) + 1)).alias("m2"))
    some = F.lit((1 << GROUP_LETTERS) - 1).cast("long")
    group = F.shiftleft(F.col("words").cast("long"), 2 * GROUP_LETTERS) + F.shiftleft(F.col("m1").bitwiseAND(some), GROUP_LETTERS) + F.col("m2").bitwiseAND(some)
    return placed.withColumn("grp", group)


def _probed_scores(signed: DataFrame) -> DataFrame:
    """A lower score to beat: names of every group, the longest with the fewest letters, are held against each other."""
    kind = ["grp", "shared", "score", "words", "m1", "m2"]
    kinds = signed.groupBy(*BLOCK, *kind).agg(F.max(F.struct("len", "sorted_name")).alias("c")).select(*BLOCK, *kind, "c.len", "c.sorted_name")
    kinds = kinds.withColumn("letters", F.bit_count("m1") + F.bit_count("m2"))
    order = [F.desc("len"), "letters", "sorted_name"]
    some = kinds.withColumn("place", F.row_number().over(W.partitionBy(*BLOCK, "grp").orderBy(*order))).where(F.col("place") <= PROBES)
    some = some.withColumn("at", F.row_number().over(W.partitionBy(*BLOCK).orderBy("place", *order))).where(F.col("at") <= MOST_PROBES)
    return _spread(some, *BLOCK).groupBy(*BLOCK).applyInPandas(score_probe, "dataset string, dob string, score double")


def _long_scores(names: DataFrame, found: DataFrame, chunk_names: int) -> DataFrame:
    long = found.where(F.col("n_names") > SHORT_BLOCK).select(*BLOCK)
    inside = materialise(names.join(long, BLOCK).select(*BLOCK, "sorted_name", F.char_length("sorted_name").alias("len")))
    bounds = materialise(_pivot_scores(inside))
    undecided = bounds.where("score > 0")
    if undecided.isEmpty():
        return bounds
    signed = materialise(_signatures(inside, undecided))
    bounds = materialise(bounds.unionByName(_probed_scores(signed)).groupBy(*BLOCK).agg(F.min("score").alias("score")))
    signed = signed.drop("score").join(bounds.where("score > 0"), BLOCK)
    groups = signed.groupBy(*BLOCK, "grp", "shared", "score").agg(F.max("len").cast("long").alias("longest"), F.count("*").alias("n"))
    meetings = materialise(_spread(groups, *BLOCK).groupBy(*BLOCK).applyInPandas(
        lambda part: groups_to_meet(part, GROUP_LETTERS), "dataset string, dob string, grp long, other long, least long, other_least long, n long, others long"))
    all_pairs = found.join(meetings.where("grp < 0").select(*BLOCK), BLOCK, "left_semi")
    met = meetings.where("grp >= 0")
    out = bounds.unionByName(_chunk_scores(names, all_pairs, chunk_names))
    return out if met.isEmpty() else out.unionByName(_cell_scores(signed, met, chunk_names))


def _cell_scores(signed: DataFrame, met: DataFrame, chunk_names: int) -> DataFrame:
    """The lowest score in each cell: a chunk of a group's names with a chunk of the names of the groups it meets."""
    on = [*BLOCK, "grp"]
    chunks = lambda n: F.greatest(F.ceil(F.col(n) / chunk_names), F.lit(1)).cast("int")
    own = met.groupBy(*on).agg(F.min("least").alias("least"), F.first("n").alias("n"), F.sum("others").alias("others")).select(
        *on, "least", chunks("n").alias("own_chunks"), chunks("others").alias("other_chunks"))
    facts = ["sorted_name", "len", "m1", "m2", "words", "shared", "score"]
    at = lambda of: F.pmod(F.xxhash64("sorted_name"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = signed.join(own, on).where("len >= least").select(*on, *facts, F.lit(True).alias("own"), at("own_chunks").alias("ci"), every("other_chunks").alias("cj"))
    sides = met.join(own.select(*on, "own_chunks", "other_chunks"), on).select(*BLOCK, F.col("grp").alias("to"), F.col("other").alias("grp"), "other_least", "own_chunks", "other_chunks")
    right = signed.join(sides, on).where("len >= other_least").select(
        *BLOCK, F.col("to").alias("grp"), *facts, F.lit(False).alias("own"), every("own_chunks").alias("ci"), at("other_chunks").alias("cj"))
    return _spread(left.unionByName(right), *on, "ci", "cj").groupBy(*on, "ci", "cj").applyInPandas(score_cell, "dataset string, dob string, score double")


def _chunk_scores(names: DataFrame, found: DataFrame, chunk_names: int) -> DataFrame:
    long = found.select(*BLOCK, F.least(F.ceil(F.col("n_names") / chunk_names), F.lit(MOST_CHUNKS)).cast("int").alias("chunks"))
    placed = names.select(*BLOCK, "sorted_name").join(long, BLOCK).withColumn(
        "chunk", F.pmod(F.xxhash64("sorted_name"), F.col("chunks")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *BLOCK, "sorted_name", "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"))
    return _spread(sent, *BLOCK, "ci", "cj").groupBy(*BLOCK, "ci", "cj").applyInPandas(score_chunk_pair, "dataset string, dob string, score double")


def find_clusters(rows: DataFrame, chunk_names: int = CHUNK_NAMES) -> DataFrame:
    """One header row per cluster: size, score, tier, position of its first member, index."""
    names = materialise(block_names(rows))
    found = blocks(names)
    scores = (_short_scores(names, found).unionByName(_long_scores(names, found, chunk_names))
              .groupBy(*BLOCK).agg(F.min("score").alias("score")))
    headers = found.join(scores, BLOCK, "left").withColumn("score", F.coalesce("score", F.lit(100.0)))
    headers = headers.select(
        *BLOCK, "size", "n_names", "first_pos", F.round("score", 1).alias("min_name_similarity"),
        F.when(F.col("score") >= P.NAME_THRESHOLD, "high_confidence").otherwise("needs_review").alias("tier"),
    ).withColumn("_review", F.col("tier") == "needs_review").withColumn("_smaller", -F.col("size"))
    ranked = numbered(headers, ["dataset"], ["_review", "_smaller", "first_pos"], "_n")
    return ranked.withColumn("cluster_index", F.col("_n") - 1).drop("_n", "_review", "_smaller")


def members(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    return rows.join(clusters.select(*BLOCK, "cluster_index"), BLOCK)


def summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("dataset").agg(
        F.count("*").alias("clusters"), F.count_if(F.col("tier") == "high_confidence").alias("high_confidence"),
        F.count_if(F.col("tier") == "needs_review").alias("needs_review"), F.sum("size").alias("records_involved"))


def unseen(clusters: DataFrame, rows: DataFrame, decided_members: DataFrame) -> DataFrame:
    """Clusters whose exact member set has not been decided before.

    A set has a fingerprint that combines before the shuffle: its number of members and two exclusive-ors of
    their hashes. Members are compared only where fingerprints agree, so sets of any size are never lists and
    sets that merely overlap cost nothing further.
    """
    old = decided_members.select("dataset", "cluster_id", "row_id").distinct()
    new = rows.select(*BLOCK, "row_id").distinct()
    print_of = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("row_id")).alias("f1"), F.bit_xor(F.xxhash64(F.lit("other"), "row_id")).alias("f2")]
    alike = new.groupBy(*BLOCK).agg(*print_of).join(old.groupBy("dataset", "cluster_id").agg(*print_of), ["dataset", "n", "f1", "f2"])
    both = new.join(alike.select(*BLOCK, "cluster_id", "n"), BLOCK).join(old, ["dataset", "cluster_id", "row_id"])
    same = both.groupBy(*BLOCK, "cluster_id", "n").agg(F.count("*").alias("shared")).where(F.col("shared") == F.col("n"))
    return clusters.join(same.select(*BLOCK).distinct(), BLOCK, "left_anti")


EVIDENCE = {"min_name_similarity": "double", "cluster_index": "bigint", "decided_by": "string", "decided_at": "timestamp"}


def refreshed_queue(decisions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Decided clusters stay; the old pending ones are replaced by the fresh findings, renumbered without those suppressed."""
    facts = ["dataset", "dob", "size", "tier", "status"]
    shaped = lambda df: df.select(*facts, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in EVIDENCE.items()])
    if "cluster_index" in fresh.columns:
        fresh = numbered(fresh, ["dataset"], ["cluster_index", "dob"], "_n").withColumn("cluster_index", F.col("_n") - 1).drop("_n")
    return shaped(decisions.where("status <> 'pending'")).unionByName(shaped(fresh.withColumn("status", F.lit("pending"))))


def pending(queue: DataFrame) -> DataFrame:
    """The clusters to review, in the order of their index."""
    return queue.where("status = 'pending'").orderBy("dataset", F.asc_nulls_last("cluster_index"))


# ---- decisions -----------------------------------------------------------------------

def bulk_confirm(decisions: DataFrame, decided_by: str, decided_at: str, tier: str | None = None, dataset: str | None = None) -> DataFrame:
    """Confirms every pending cluster (of one tier and dataset, when given)."""
    hit = F.col("status") == "pending"
    if tier:
        hit &= F.col("tier") == tier
    if dataset:
        hit &= F.col("dataset") == dataset
    return (decisions.withColumn("newly_confirmed", hit)
            .withColumn("decided_by", F.when(hit, F.lit(decided_by)).otherwise(F.col("decided_by")))
            .withColumn("decided_at", F.when(hit, F.lit(decided_at).cast("timestamp")).otherwise(F.col("decided_at")))
            .withColumn("status", F.when(hit, "confirmed_duplicate").otherwise(F.col("status"))))


def confirm_target(decisions: DataFrame) -> str:
    """The only dataset with pending clusters; none or several is an error."""
    names = [r[0] for r in decisions.where("status = 'pending'").select("dataset").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("no pending clusters" if not names else "several datasets have pending clusters; name one")
    return names[0]


def decide(decisions: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies (cluster_id, choice, actor, at) rows; every invalid or unknown one comes back with a reason.

    A cluster's last valid choice counts (of equal times the greatest); a refused one changes nothing.
    """
    allowed = F.coalesce(F.col("choice").isin("confirmed_duplicate", "not_duplicate"), F.lit(False))
    order = F.struct(F.coalesce("at", F.lit("0001-01-01").cast("timestamp")), "choice", "actor")
    valid = (choices.where(allowed).groupBy("cluster_id").agg(F.max(F.struct(order.alias("o"), "choice", "actor", "at")).alias("c"))
             .select("cluster_id", "c.choice", "c.actor", "c.at"))
    updated = (decisions.join(valid, "cluster_id", "left")
               .withColumn("status", F.coalesce("choice", "status"))
               .withColumn("decided_by", F.coalesce("actor", "decided_by"))
               .withColumn("decided_at", F.coalesce("at", "decided_at")).drop("choice", "actor", "at"))
    given = choices.select("cluster_id", "choice", "actor", "at")
    unknown = given.where(allowed).join(decisions, "cluster_id", "left_anti").withColumn("reason", F.lit("unknown cluster"))
    return updated, unknown.unionByName(given.where(~allowed).withColumn("reason", F.lit("invalid status")))


def queue(decisions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Pending and decided clusters of registered datasets only."""
    return decisions.join(datasets.select("dataset"), "dataset", "left_semi").withColumn("pending", F.col("status") == "pending")


def audit(decisions: DataFrame, limit: int | None = None) -> DataFrame:
    """Decided clusters, newest first; a page of them where a limit is given."""
    out = decisions.where("status <> 'pending'").orderBy(F.desc("decided_at"), F.desc("cluster_id"))
    return out if limit is None else out.limit(limit)


def audit_statistics(decisions: DataFrame) -> DataFrame:
    done = F.col("status") != "pending"
    return decisions.agg(
        F.count_if(done).alias("total"), F.count_if(F.col("status") == "confirmed_duplicate").alias("merged"),
        F.count_if(F.col("status") == "not_duplicate").alias("rejected"),
        F.count_if(done & (F.col("tier") == "high_confidence")).alias("high_confidence"))


def pending_by_dataset(decisions: DataFrame) -> DataFrame:
    return decisions.where("status = 'pending'").groupBy("dataset").agg(
        F.count("*").alias("pending"), F.count_if(F.col("tier") == "high_confidence").alias("high_confidence"))


def lifecycle_counts(decisions: DataFrame, golden: DataFrame | None = None) -> DataFrame:
    """Clusters per state and golden records, per dataset."""
    out = decisions.groupBy("dataset").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "confirmed_duplicate", "not_duplicate")])
    if golden is None:
        return out
    made = golden.groupBy("dataset").agg(F.count("*").alias("golden_records"))
    return out.join(made, "dataset", "left").withColumn("golden_records", F.coalesce("golden_records", F.lit(0)))


def search_decided(decisions: DataFrame, text: str, sort_by: str = "decided_at", ascending: bool = False) -> DataFrame:
    """Decided clusters whose lead member or decider contains the text."""
    sorts = ("decided_at", "decided_by", "size", "tier", "lead_name")
    if sort_by not in sorts:
        raise ValueError(f"sort_by must be one of {sorts}")
    q = F.lit(text.strip().lower())
    hit = F.contains(F.lower("lead_name"), q) | F.contains(F.lower("decided_by"), q)
    order = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    return decisions.where((F.col("status") != "pending") & hit).orderBy(order, "cluster_id")

"""Entity resolution: which names of a case and type mean the same entity.

Score = 0.6 cosine + 0.4 token Jaccard, merge at 0.78.  As cosine is at most 1, a pair at
the threshold has Jaccard 0.45 or more.  So pairs meet on prefixes: the tokens of a name
are put in one order for all names, rarest first, and two names that share 0.45 of their
tokens share one among the first ``n - ceil(0.45 n) + 1``.  A name has at most as many keys
as tokens and nothing is lost.  A key with very many names is cut into a grid of
sub-blocks, and the score is part of the join condition, so pairs below the threshold are
never written.

Who is canonical depends on the order of the names, but only inside a connected component of
similar names: components are found first, and each is then folded in order by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import dot, rounded, unit
from ..session import cut_lineage
from .graph import connected_components
from .knowledge import name_jaccard, name_tokens, normalize_entity_name

BLOCK_NAMES = 1_000


def distinct_names(entities: DataFrame, vector: str | None = None, keys: tuple[str, ...] = ("case_id", "entity_type")) -> DataFrame:
    """One row per different name; copies of a name are combined before the shuffle."""
    aggs = [F.min("entity_id").alias("first_id")]
    if vector:
        aggs.append(F.min_by(vector, "entity_id").alias("vector"))
    names = entities.groupBy(*keys, "name").agg(*aggs)
    names = names.withColumn("clean", normalize_entity_name("name")).withColumn("tokens", name_tokens("clean"))
    return names.withColumn("vector", unit("vector") if vector else F.lit(None).cast("array<double>"))


def _grid(df: DataFrame, keys: list[str], left: bool) -> DataFrame:
    """Rows of a block spread over the cells of their row (or column) of the grid."""
    own, other = ("_i", "_j") if left else ("_j", "_i")
    return df.withColumn(own, F.pmod(F.xxhash64("name"), F.col("_m"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))


def _rare_first(names: DataFrame, keys: list[str]) -> DataFrame:
    """Names with their tokens in the order of how many names of the key hold them, then by the token."""
    each = names.select(*keys, "first_id", F.explode("tokens").alias("_t"))
    held = each.groupBy(*keys, "_t").agg(F.count("*").alias("_f"))
    ordered = each.join(held, [*keys, "_t"]).groupBy(*keys, "first_id").agg(F.array_sort(F.collect_list(F.struct("_f", "_t"))).alias("_o"))
    return names.drop("tokens").join(ordered.select(*keys, "first_id", F.transform("_o", lambda x: x["_t"]).alias("tokens")), [*keys, "first_id"])


def similar_names(names: DataFrame, threshold: float = rules.MERGE_THRESHOLD, keys: tuple[str, ...] = ("case_id", "entity_type"),
                  block: int = BLOCK_NAMES) -> DataFrame:
    """Pairs (earlier name, later name, score) at or above the threshold, as ``a_id``, ``b_id``."""
    need = (threshold - rules.COSINE_WEIGHT) / rules.JACCARD_WEIGHT
    if need <= 0:
        raise ValueError("below this threshold names without a common token may be similar")
    keys = list(keys)
    n = F.size("tokens")
    keyed = _rare_first(names.filter(n > 0), keys).withColumn("_prefix", F.slice("tokens", F.lit(1), (n - F.ceil(n * need - 1e-9) + 1).cast("int")))
    keyed = keyed.select(*keys, "name", "first_id", "clean", "tokens", "vector", "_prefix", F.explode("_prefix").alias("_key"))
    sizes = keyed.groupBy(*keys, "_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    keyed = keyed.join(sizes, [*keys, "_key"]).withColumn("_m", F.ceil(F.col("_n") / block)).drop("_n")
    a, b = _grid(keyed, keys, True).alias("a"), _grid(keyed, keys, False).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*keys, "_key", "_i", "_j"]]
    at, bt = F.col("a.tokens"), F.col("b.tokens")
    # Each pair is taken once: on the rarest token that both prefixes have.
    once = F.col("a._key") == F.get(F.array_intersect("a._prefix", "b._prefix"), F.lit(0))
    score = pair_score(F.col("a.clean"), F.col("b.clean"), at, bt, F.col("a.vector"), F.col("b.vector"))
    cond = (F.col("a.first_id") < F.col("b.first_id")) & F.coalesce(once, F.lit(False)) & (name_jaccard(at, bt) >= need - 1e-9) & (score >= threshold)
    for s in same:
        cond = cond & s
    return a.join(b, cond).select(*[F.col(f"a.{k}") for k in keys], F.col("a.first_id").alias("a_id"), F.col("b.first_id").alias("b_id"), score.alias("score"))


def pair_score(clean_a: Column, clean_b: Column, tokens_a: Column, tokens_b: Column, unit_a: Column, unit_b: Column) -> Column:
    """Without vectors the cosine is 1 for equal names and 0 otherwise."""
    cosine = F.coalesce(dot(unit_a, unit_b), F.when(clean_a == clean_b, 1.0).otherwise(0.0))
    return cosine * rules.COSINE_WEIGHT + name_jaccard(tokens_a, tokens_b) * rules.JACCARD_WEIGHT


#: Pairs of a component that one task folds (16 bytes each); larger components are settled in rounds.
FOLD_PAIRS = 1 << 20


def _fold_component(rows: pa.Table) -> pa.Table:
    """The ids that stay canonical in one component: in order, those with no earlier canonical neighbour."""
    a, b = rows.column("a_id").to_numpy(), rows.column("b_id").to_numpy()
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    merged: set = set()
    for earlier, later in zip(a.tolist(), b.tolist(), strict=True):
        # All pairs that end in ``earlier`` came before, as it is the smaller id.
        if earlier not in merged:
            merged.add(later)
    ids = np.unique(np.concatenate([a, b]))
    return pa.table({"id": ids[~np.isin(ids, np.fromiter(merged, ids.dtype, len(merged)))]})


def _canonical_ids(pairs: DataFrame, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """Names that stay canonical among those with any similar name.

    Taken in order, a name is canonical unless it is similar to an earlier canonical one.  The
    order matters only inside a component of the pairs, which one task folds.
    """
    edges = cut_lineage(pairs.select("a_id", "b_id"))
    roots = connected_components(edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    rooted = edges.join(roots.select(F.col("node").alias("a_id"), "root"), "a_id")
    sizes = rooted.groupBy("root").agg(F.count("*").alias("_n"))
    rooted = cut_lineage(rooted.join(sizes, "root").select("root", "a_id", "b_id", (F.col("_n") > fold_pairs).alias("_large")))
    folded = rooted.filter("not _large").groupBy("root").applyInArrow(_fold_component, f"id {edges.schema['a_id'].dataType.simpleString()}")
    large = rooted.filter("_large").select("a_id", "b_id")
    return folded if large.isEmpty() else folded.union(_canonical_in_rounds(large))


def _canonical_in_rounds(edges: DataFrame) -> DataFrame:
    """The same for components too large for a task: names without an earlier undecided neighbour are canonical, their later neighbours are merged, both leave."""
    open_ids = cut_lineage(edges.select(F.col("a_id").alias("id")).union(edges.select("b_id")).distinct())
    found = None
    while not open_ids.isEmpty():
        chosen = cut_lineage(open_ids.join(edges.select(F.col("b_id").alias("id")).distinct(), "id", "left_anti"))
        merged = edges.join(chosen.select(F.col("id").alias("a_id")), "a_id", "left_semi").select(F.col("b_id").alias("id")).distinct()
        done = cut_lineage(chosen.union(merged))
        open_ids = cut_lineage(open_ids.join(done, "id", "left_anti"))
        edges = cut_lineage(edges.join(done.withColumnRenamed("id", "a_id"), "a_id", "left_anti").join(done.withColumnRenamed("id", "b_id"), "b_id", "left_anti"))
        found = chosen if found is None else found.union(chosen)
    return open_ids if found is None else found


def resolve_entities(entities: DataFrame, vector: str | None = None, threshold: float = rules.MERGE_THRESHOLD,
                     keys: tuple[str, ...] = ("case_id", "entity_type")) -> DataFrame:
    """Entities in the order of their id: join the best earlier canonical entity, or become one.

    Adds ``status`` (canonical or merged), ``canonical_id`` and ``similarity`` (3 digits).
    Without vectors only equal cleaned names reach the threshold, so one aggregate settles them.
    """
    if vector is None:
        return _resolve_by_name(entities, keys)
    every = cut_lineage(distinct_names(entities, vector, keys))
    # Names that clean to the same text and have the same vector are similar to the same names: the first stands for all.
    same = every.groupBy(*keys, "clean", "vector").agg(F.min("first_id").alias("first_id"), F.min_by("name", "first_id").alias("name"), F.min_by("tokens", "first_id").alias("tokens"))
    same = same.filter(F.size("tokens") > 0).unionByName(every.filter(F.size("tokens") == 0).select(same.columns))
    names = cut_lineage(same)
    stands = every.select(*keys, "name", "clean", "vector", F.col("first_id").alias("_own")).join(
        names.select(*keys, "clean", "vector", "first_id", F.size("tokens").alias("_n")), [*keys, "clean", "vector"]).filter("_n > 0 or first_id = _own")
    pairs = cut_lineage(similar_names(names, threshold, keys))
    canonical = cut_lineage(_canonical_ids(pairs))
    touched = pairs.select(F.col("a_id").alias("first_id")).union(pairs.select("b_id")).distinct()
    alone = names.join(touched, "first_id", "left_anti").select("first_id")
    heads = canonical.select(F.col("id").alias("first_id")).union(alone)
    # Candidates of a name: similar canonical names, and the name itself when it is canonical.
    both = pairs.select("a_id", "b_id", "score").union(pairs.select("b_id", "a_id", "score")).toDF("first_id", "head_id", "score")
    others = both.join(heads.withColumnRenamed("first_id", "head_id"), "head_id", "left_semi").select("first_id", "head_id", "score")
    own = names.filter(F.size("tokens") > 0).join(heads, "first_id", "left_semi").select("first_id", F.col("first_id").alias("head_id"), F.lit(1.0).alias("score"))
    options = others.union(own)
    ids = entities.join(stands.select(*keys, "name", "first_id"), [*keys, "name"]).select("entity_id", "first_id")
    best = (
        ids.join(options, "first_id").filter(F.col("head_id") < F.col("entity_id")).groupBy("entity_id")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("head_id").alias("h"))).alias("m"))
        .select("entity_id", F.col("m.h").alias("canonical_id"), rounded(-F.col("m.s"), 3).alias("similarity"))
    )
    return entities.join(best, "entity_id", "left").withColumn(
        "status", F.when(F.col("canonical_id").isNull(), "canonical").otherwise("merged"))


def _resolve_by_name(entities: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    cleaned = entities.withColumn("_clean", normalize_entity_name("name"))
    first = cleaned.filter(F.size(name_tokens("_clean")) > 0).groupBy(*keys, "_clean").agg(F.min("entity_id").alias("_first"))
    merged = F.col("_first") < F.col("entity_id")
    return cleaned.join(first, [*keys, "_clean"], "left").select(
        *entities.columns, F.when(merged, F.col("_first")).alias("canonical_id"), F.when(merged, F.lit(1.0)).alias("similarity"),
        F.when(merged, "merged").otherwise("canonical").alias("status"))


def aliases(resolved: DataFrame) -> DataFrame:
    """(canonical_id, alias): the other names merged into an entity, one row each."""
    head = resolved.filter("status = 'canonical'").select(F.col("entity_id").alias("canonical_id"), F.col("name").alias("_own"))
    return resolved.filter("status = 'merged'").select("canonical_id", F.col("name").alias("alias")).distinct().join(head, "canonical_id").filter(
        "alias <> _own").drop("_own")


def merge_history(resolved: DataFrame) -> DataFrame:
    """One row per merge: canonical entity, merged entity, its name and the score."""
    head = resolved.filter("status = 'canonical'").select(F.col("entity_id").alias("canonical_id"), F.col("name").alias("canonical_name"))
    return resolved.filter("status = 'merged'").select("canonical_id", F.col("entity_id").alias("merged_entity_id"), F.col("name").alias("original_name"),
                                                       "similarity").join(head, "canonical_id")

"""The concept graph: presence of concepts in passages, edges and their provenance, stances, weights, gaps, merges.

Concepts are (concept, label, aliases), passages (passage, doc, text), presence (concept, doc, passage, n),
edges (a, b) with a < b. Nulls join with nothing; empty tables give empty results; repeated rows of
presence count as their sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import casefold, stem_candidates
from lectern.operators import graph
from lectern.operators.scratch import materialize

# Stances that support and oppose, the least dated documents of a side, the gap kinds in order.
SUPPORTING, OPPOSING = ("supports", "extends", "agrees"), ("contradicts", "refutes", "disagrees")
DATED_SIDE = 2
GAP_KINDS = ("unsourced_claim", "thin_bridge", "single_source", "isolated", "under_connected")
#: A vocabulary of at most so many forms is broadcast to the passages.
BROADCAST_FORMS = 100_000


def surface_forms(concepts: DataFrame) -> DataFrame:
    """concept, form: label and aliases, trimmed and folded, each once, none empty."""
    names = concepts.select("concept", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    return names.select("concept", casefold(F.trim("form")).alias("form")).filter("form <> ''").distinct()


def boundary_pattern(form: Column) -> Column:
    """The form as it stands, with neither letter nor digit before or after it."""
    return F.concat(F.lit(r"(?<![a-z0-9])\Q"), form, F.lit(r"\E(?![a-z0-9])"))


def match_presence(concepts: DataFrame, passages: DataFrame, shortest: int = 1) -> DataFrame:
    """concept, doc, passage, n: how often the forms of a concept stand in a passage as whole words.

    A form's first run of letters and digits is a whole run of any passage that holds it, so runs are
    joined by equality and only such passages are searched. Forms without such a run, or shorter than
    ``shortest``, match nothing.
    """
    run = "[a-z0-9]+"
    forms = surface_forms(concepts).filter(F.length("form") >= shortest).withColumn("key", F.regexp_extract("form", run, 0)).filter("key <> ''")
    small = forms.count() <= BROADCAST_FORMS
    folded = passages.select("passage", "doc", casefold(F.col("text")).alias("low"))
    runs = folded.select("passage", "doc", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(run), 0))).alias("key"))
    hit = runs.join(F.broadcast(forms) if small else forms, "key").withColumn("n", F.regexp_count("low", boundary_pattern(F.col("form"))))
    return hit.filter("n > 0").groupBy("concept", "doc", "passage").agg(F.sum("n").cast("long").alias("n"))


def presence_rows(presence: DataFrame) -> DataFrame:
    """concept, doc, n_mentions, n_passages."""
    return presence.groupBy("concept", "doc").agg(F.sum("n").alias("n_mentions"), F.count_distinct("passage").alias("n_passages"))


def cooccurrence_edges(presence: DataFrame, least: int) -> DataFrame:
    """a, b, chunks: concepts that stand together in at least ``least`` passages; pairs are those of one passage's concepts."""
    held = presence.groupBy("passage").agg(F.array_sort(F.collect_set("concept")).alias("c"))
    pairs = held.select(F.posexplode("c").alias("i", "a"), "c").select("a", F.explode(F.expr("slice(c, i + 2, size(c))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("chunks")).filter(F.col("chunks") >= least)


def provenance_strength(edges: DataFrame, presence: DataFrame, links: DataFrame) -> DataFrame:
    """a, b, strength: the share of pairs of different documents of both ends that ``links`` (a, b) joins, either way.

    Candidate pairs are counted from the sizes of the document sets, not formed; only links are
    followed. Edges of no linked pair have no row, and no edge is made.
    """
    docs = presence.select("concept", "doc").distinct()
    size = docs.groupBy("concept").agg(F.count("*").alias("n"))
    left, right = (docs.select(F.col("concept").alias(e), F.col("doc").alias(f"d{e}")) for e in ("a", "b"))
    own = edges.select("a", "b").join(left, "a")
    shared = own.join(docs.select(F.col("concept").alias("b"), F.col("doc").alias("da")), ["b", "da"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    linked = own.join(graph.both_ways(links).select(F.col("a").alias("da"), F.col("b").alias("db")), "da").join(right, ["b", "db"]).groupBy("a", "b").agg(F.count("*").alias("hit"))
    sized = linked.join(size.select(F.col("concept").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("concept").alias("b"), F.col("n").alias("nb")), "b")
    both = sized.join(shared, ["a", "b"], "left")
    return both.select("a", "b", F.round(F.col("hit") / (F.col("na") * F.col("nb") - F.coalesce("shared", F.lit(0))), 6).alias("strength"))


def weighted_edges(edges: DataFrame, strengths: dict[str, DataFrame]) -> DataFrame:
    """``edges`` with provenance (sorted names, cooccurrence among them), the strengths by name, and the weight."""
    out = edges
    for name, table in strengths.items():
        out = out.join(table.withColumnRenamed("strength", f"s_{name}"), ["a", "b"], "left")
    parts = [F.struct(F.lit(n).alias("name"), F.col(f"s_{n}").alias("strength")) for n in sorted(strengths)]
    known = F.filter(F.array(*parts), lambda p: p["strength"].isNotNull()) if parts else F.array()
    out = out.withColumn("known", known)
    mean = F.when(F.size("known") > 0, F.aggregate("known", F.lit(0.0), lambda s, p: s + p["strength"]) / F.size("known")).otherwise(0.0)
    weight = graph.edge_weight(1 + F.size("known"), mean, F.col("chunks"))
    names = F.array_sort(F.concat(F.array(F.lit("cooccurrence")), F.transform("known", lambda p: p["name"])))
    return out.select(*edges.columns, F.array_join(names, ",").alias("provenance"), weight.alias("weight"))


def contested_edges(stances: DataFrame) -> DataFrame:
    """a, b, n_supporting, n_opposing of edges with documents on either side; stances are a, b, doc, polarity."""
    sides = [F.count_distinct(F.when(F.col("polarity").isin(*side), F.col("doc"))).alias(n) for n, side in (("n_supporting", SUPPORTING), ("n_opposing", OPPOSING))]
    return stances.groupBy("a", "b").agg(*sides).filter("n_supporting > 0 AND n_opposing > 0")


def stance_profile(stances: DataFrame) -> DataFrame:
    """a, b, n_polarities, n_stances, and share of one relation and side each: what a report of an edge shows."""
    return stances.groupBy("a", "b").agg(F.count_distinct("polarity").alias("n_polarities"), F.count("*").alias("n_stances"), F.max("polarity").alias("last_polarity"))


def node_weights(nodes: DataFrame, stances: DataFrame, years: DataFrame) -> DataFrame:
    """concept, n_supporting, n_opposing, agreement, coverage, direction for every node.

    A node has the documents of all edges at it. With any opposing one it is contested, and its
    direction is superseded_trend where both sides have DATED_SIDE documents or more, all of them dated
    (``years``: doc, year), and the opposing ones' median year is later. Else it is unique with one
    supporting document or none, and corroborated with more.
    """
    ends = stances.select(F.explode(F.array("a", "b")).alias("concept"), "doc", F.when(F.col("polarity").isin(*SUPPORTING), 1).when(F.col("polarity").isin(*OPPOSING), 0).alias("side"))
    sides = ends.filter("side IS NOT NULL").distinct().join(years, "doc", "left")
    year = [F.when(F.col("side") == k, F.col("year")) for k in (0, 1)]
    agg = sides.groupBy("concept").agg(
        F.sum("side").alias("s"),
        F.sum(1 - F.col("side")).alias("o"),
        F.bool_and(F.col("year").isNotNull()).alias("dated"),
        F.median(year[1]).alias("ms"),
        F.median(year[0]).alias("mo"),
    )
    out = nodes.select("concept").distinct().join(agg, "concept", "left")
    s, o = (F.coalesce(c, F.lit(0)).cast("long") for c in ("s", "o"))
    later = (s >= DATED_SIDE) & (o >= DATED_SIDE) & F.col("dated") & (F.col("mo") > F.col("ms"))
    return out.select(
        "concept",
        s.alias("n_supporting"),
        o.alias("n_opposing"),
        F.when(s + o > 0, F.round(s / (s + o), 4)).otherwise(1.0).alias("agreement"),
        F.when(o > 0, "contested").when(s > 1, "corroborated").otherwise("unique").alias("coverage"),
        F.when(o == 0, "stable").when(F.coalesce(later, F.lit(False)), "superseded_trend").otherwise("contested").alias("direction"),
    )


def markers(n_contested: Column, n_superseded: Column) -> Column:
    """The markers of a passage; none for a clean one."""
    return F.array_compact(F.array(F.when(n_contested > 0, "contested"), F.when(n_superseded > 0, "superseded_trend")))


def project_weights(presence: DataFrame, weights: DataFrame) -> DataFrame:
    """passage, doc, n_claims, n_corroborated, n_unique, n_contested, n_superseded, markers of passages with a weighted concept."""
    joined = presence.select("passage", "doc", "concept").distinct().join(weights, "concept")
    counts = [F.count_if(F.col("coverage") == c).alias(f"n_{c}") for c in ("corroborated", "unique", "contested")]
    agg = joined.groupBy("passage", "doc").agg(F.count("*").alias("n_claims"), *counts, F.count_if(F.col("direction") == "superseded_trend").alias("n_superseded"))
    return agg.withColumn("markers", F.array_join(markers(F.col("n_contested"), F.col("n_superseded")), ","))


def coverage_label(n_contested: Column, n_corroborated: Column, n_claims: Column) -> Column:
    """contested, else corroborated, else unique; null without any claim."""
    return F.when(n_claims == 0, None).when(n_contested > 0, "contested").when(n_corroborated > 0, "corroborated").otherwise("unique")


def marked(passages: DataFrame, projected: DataFrame) -> DataFrame:
    """passage, markers of the asked passages that have any."""
    return passages.select("passage").distinct().join(projected.filter("markers <> ''").select("passage", "markers"), "passage")


def reattach_stances(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Fresh edges with the relation that was known before (a, b, relation); a relation is one more provenance."""
    both = edges.join(kept.select("a", "b", "relation"), ["a", "b"], "left")
    return both.withColumn("weight", F.round(F.col("weight") + F.when(F.col("relation").isNotNull(), 1.0).otherwise(0.0), 6))


def single_source(presence: DataFrame) -> DataFrame:
    """concept, doc: concepts that one document alone has."""
    return presence.groupBy("concept").agg(F.min("doc").alias("doc"), F.count_distinct("doc").alias("k")).filter("k = 1").drop("k")


def unsourced_claims(claims: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept, claims: the identifiers, sorted, of unsupported claims (claim, text, marker) in which it stands."""
    texts = claims.filter("marker = 'unsupported'").select(F.col("claim").alias("passage"), F.col("claim").alias("doc"), "text")
    hit = match_presence(concepts, texts).groupBy("concept").agg(F.array_sort(F.collect_set("passage")).alias("claims"))
    return hit.withColumn("claims", F.array_join("claims", ","))


def gap_rank(kind: Column) -> Column:
    out = F.lit(len(GAP_KINDS))
    for k, name in enumerate(GAP_KINDS):
        out = F.when(kind == name, k).otherwise(out)
    return out


def gap_list(gaps: DataFrame, triage: DataFrame, labels: DataFrame) -> DataFrame:
    """concept, kind, label, status, rank: gaps with their own status, the triage's where there is one, and label or identifier."""
    own = gaps.select("concept", "kind", "status").join(triage.select("concept", "kind", F.col("status").alias("t")), ["concept", "kind"], "left").join(labels.select("concept", "label"), "concept", "left")
    return own.select("concept", "kind", F.coalesce("label", F.col("concept").cast("string")).alias("label"), F.coalesce("t", "status").alias("status"), gap_rank(F.col("kind")).alias("rank"))


def visible_gaps(listed: DataFrame, under_connected: bool = False) -> DataFrame:
    """Gaps that are not dismissed; under-connected ones only where asked for."""
    kept = listed.filter("status <> 'dismissed'")
    return kept if under_connected else kept.filter("kind <> 'under_connected'")


def index_rows(nodes: DataFrame, gaps: DataFrame, gaps_only: bool = False) -> DataFrame:
    """concept, label, best_rank, n_gaps: nodes with their most pressing gap."""
    best = gaps.groupBy("concept").agg(F.min("rank").alias("best_rank"), F.count("*").alias("n_gaps"))
    out = nodes.select("concept", "label").join(best, "concept", "inner" if gaps_only else "left")
    return out.withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))


def replace_gaps(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Deterministic rows are replaced by ``fresh``; others stay (concept, kind, determinism, status)."""
    return stored.filter("determinism <> 'deterministic'").unionByName(fresh)


def suggest_gaps(stored: DataFrame, suggested: DataFrame, alive: DataFrame) -> DataFrame:
    """Stochastic rows take the suggestions (concept, kind), but promoted and dismissed ones stay; those of concepts not ``alive`` go."""
    fixed = stored.filter("determinism = 'stochastic'").join(alive.select("concept").distinct(), "concept", "left_semi")
    new = suggested.select("concept", F.col("kind").alias("new_kind"))
    both = fixed.join(new, "concept", "full_outer")
    keep = F.col("status").isin("promoted", "dismissed") | F.col("new_kind").isNull()
    merged = both.select("concept", F.when(keep, F.col("kind")).otherwise(F.col("new_kind")).alias("kind"), F.lit("stochastic").alias("determinism"), F.when(keep, F.col("status")).otherwise("surfaced").alias("status"))
    return stored.filter("determinism <> 'stochastic'").unionByName(merged)


def set_triage(triage: DataFrame, edits: DataFrame) -> DataFrame:
    """Triage rows (concept, kind, status) after the edits; surfaced deletes an override."""
    kept = triage.join(edits.select("concept", "kind"), ["concept", "kind"], "left_anti")
    return kept.unionByName(edits.filter("status <> 'surfaced'"))


def merge_plan(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept, keeper: groups of concepts joined by ``pairs`` (a, b); the one with the most documents stays, then
    the shortest label, then the smallest identifier. ``concepts`` has concept (a number), label, n_docs."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    groups = graph.components(nodes, pairs).withColumnRenamed("node", "concept")
    rows = materialize(groups.join(concepts, "concept"), "merges")
    order = F.struct((-F.col("n_docs")).alias("d"), F.length("label").alias("l"), "concept")
    best = rows.groupBy("component").agg(F.min(order).alias("x")).select("component", F.col("x.concept").alias("keeper"))
    return rows.join(best, "component").select("concept", "keeper")


def apply_merges(concepts: DataFrame, plan: DataFrame) -> DataFrame:
    """concept, label, aliases after the merges: a keeper has the labels and aliases of its group, its own label left out."""
    both = concepts.join(plan, "concept", "left").withColumn("keeper", F.coalesce("keeper", "concept"))
    names = both.groupBy("keeper").agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("label"), "aliases")))).alias("names"))
    own = concepts.join(names, F.col("concept") == F.col("keeper"))
    return own.select("concept", "label", F.array_sort(F.filter("names", lambda x: casefold(x) != casefold(F.col("label")))).alias("aliases"))


def morphological_families(names: DataFrame) -> DataFrame:
    """canonical, members: names (name) of which the stems meet; the shortest name, then the first, is canonical.

    Names and stems are the two sides of a graph whose components are the families.
    """
    each = names.select("name").distinct().withColumn("id", F.xxhash64("name", F.lit("name")))
    each = materialize(each, "names")
    edges = each.select("id", F.explode(stem_candidates(casefold(F.col("name")))).alias("stem")).select(F.col("id").alias("a"), F.xxhash64("stem", F.lit("stem")).alias("b"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    groups = graph.components(nodes, edges).join(each.withColumnRenamed("id", "node"), "node")
    order = F.struct(F.length("name").alias("n"), casefold(F.col("name")).alias("f"), "name")
    listed = groups.groupBy("component").agg(F.array_sort(F.collect_list(order)).alias("o")).filter("size(o) > 1")
    rest = F.array_sort(F.transform(F.slice("o", 2, F.size("o")), lambda x: F.struct(x["f"].alias("f"), x["name"].alias("name"))))
    return listed.select(F.col("o")[0]["name"].alias("canonical"), F.array_join(F.transform(rest, lambda x: x["name"]), ",").alias("members"))


def cluster_links(members: DataFrame, edges: DataFrame) -> DataFrame:
    """x, y: clusters (doc, cluster) that any edge (a, b) joins, either way."""
    a, b = (members.select(F.col("doc").alias(e), F.col("cluster").alias(c)) for e, c in (("a", "x"), ("b", "y")))
    return graph.both_ways(edges).join(a, "a").join(b, "b").filter("x <> y").select("x", "y").distinct()


def document_clusters(presence: DataFrame, communities: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, cluster: the community (concept, community) with the most of the document's concepts, the lowest of equals; solo:doc without any."""
    votes = presence.select("doc", "concept").distinct().join(communities, "concept").groupBy("doc", "community").agg(F.count("*").alias("k"))
    best = votes.groupBy("doc").agg(F.min(F.struct((-F.col("k")).alias("k"), "community")).alias("x"))
    return docs.select("doc").distinct().join(best, "doc", "left").select("doc", F.coalesce(F.col("x.community").cast("string"), F.concat(F.lit("solo:"), F.col("doc").cast("string"))).alias("cluster"))


def neighbour_labels(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept, labels: the distinct labels of its neighbours, sorted."""
    around = graph.both_ways(edges).join(concepts.select(F.col("concept").alias("b"), "label"), "b")
    return around.groupBy(F.col("a").alias("concept")).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def concept_context(presence: DataFrame, titles: DataFrame, k: int = 3) -> DataFrame:
    """concept, place, title: the titles of the documents with the most mentions."""
    rows = presence_rows(presence).join(titles.select("doc", "title"), "doc")
    best = Window.partitionBy("concept").orderBy(F.desc("n_mentions"), "doc")
    return rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("concept", "place", "title")


def staleness(vocabulary: DataFrame, built: DataFrame) -> DataFrame:
    """concept, state: added to the vocabulary since the graph was built, or removed from it."""
    added = vocabulary.select("concept").distinct().join(built.select("concept"), "concept", "left_anti").withColumn("state", F.lit("added"))
    return added.unionByName(built.select("concept").distinct().join(vocabulary.select("concept"), "concept", "left_anti").withColumn("state", F.lit("removed")))


def graph_version(edges: DataFrame, settings: str = "") -> DataFrame:
    """One row, version: sixteen digits of a digest of all edges, whatever their order, and the settings."""
    part = F.sha2(F.concat_ws("|", "a", "b", F.col("chunks").cast("string")), 256)
    sums = [F.sum(F.conv(F.substring(part, 1 + 8 * k, 8), 16, 10).cast("long")) for k in range(4)]
    return edges.agg(F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(F.coalesce(s, F.lit(0)).cast("string") for s in sums), F.lit(settings)), 256), 1, 16).alias("version"))

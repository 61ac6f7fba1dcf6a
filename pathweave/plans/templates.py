"""The named patterns, the intents that choose them, and fallbacks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.plans.pattern import Expand, Union, compile_pattern, expand, reachable, start
from pathweave.schema import EDGE_TYPES, VERTEX_TYPES
from pathweave.session import cut
from pathweave.sources.tpch_graph import Graph


def _one(kind: str, **options) -> Expand:
    return Expand((kind,), **options)


# the exception is asked for only where there is an exclusion
_EXCEPTION = (_one("EXCLUDED_IF", optional=True, then=_one("EXCEPTION_ALLOWED", optional=True)),)
_COVERAGE_CHAIN = (_one("HAS_COVERAGE"), *_EXCEPTION)

#: Steps by template, all from policies but the reverse lookup.
TEMPLATES: dict[str, tuple] = {
    "coverage_lookup": _COVERAGE_CHAIN,
    "dividend_eligibility_check": (Union(((_one("NO_DIVIDEND_STRUCTURE"),), (_one("GOVERNED_BY"), _one("EXCEPTIONALLY_ALLOWED", optional=True)))),),
    "exclusion_full_traverse": (_one("HAS_COVERAGE"), _one("EXCLUDED_IF"), _one("EXCEPTION_ALLOWED", optional=True)),
    "surrender_value_lookup": (_one("SURRENDER_PAYS"),),
    "discount_eligibility": (_one("HAS_DISCOUNT"),),
    # the second optional goes on from where the first has led
    "regulation_lookup": (_one("GOVERNED_BY"), _one("STRICTLY_PROHIBITED", optional=True), _one("EXCEPTIONALLY_ALLOWED", optional=True)),
    "regulation_reverse_lookup": (_one("GOVERNED_BY", reverse=True),),
    "calculation_lookup": (Expand(("HAS_COVERAGE", "SURRENDER_PAYS", "HAS_DISCOUNT", "HAS_RIDER")), _one("CALCULATED_BY")),
    "premium_waiver_lookup": (_one("WAIVES_PREMIUM"), *_EXCEPTION),
    "eligibility_lookup": (_one("REQUIRES_ELIGIBILITY"),),
    "rider_lookup": (_one("HAS_RIDER"),),
    "dividend_portfolio_check": (_one("NO_DIVIDEND_STRUCTURE", optional=True),),
    "comprehensive_lookup": (
        Union((
            _COVERAGE_CHAIN,
            (_one("HAS_COVERAGE"), _one("CALCULATED_BY", optional=True)),
            (_one("NO_DIVIDEND_STRUCTURE"),),
            (_one("GOVERNED_BY"), _one("EXCEPTIONALLY_ALLOWED", optional=True)),
            (_one("SURRENDER_PAYS"),),
            (_one("REQUIRES_ELIGIBILITY"),),
            (_one("HAS_RIDER"),),
            (_one("WAIVES_PREMIUM"),),
            (_one("OWNS"),),
        )),
    ),
}

# The template of each intent; others fall to coverage.
ROUTES = {
    "coverage_inquiry": "coverage_lookup",
    "dividend_check": "dividend_eligibility_check",
    "exclusion_exception": "exclusion_exception_traverse",
    "surrender_value": "surrender_value_lookup",
    "discount_eligibility": "discount_eligibility",
    "regulation_inquiry": "regulation_lookup",
    "loan_inquiry": "comprehensive_lookup",
    "premium_waiver": "premium_waiver_lookup",
    "policy_comparison": "comprehensive_lookup",
    "calculation_inquiry": "calculation_lookup",
    "eligibility_inquiry": "eligibility_lookup",
    "rider_inquiry": "rider_lookup",
}
# The types that a template is meant to find.
TARGETS = {
    "coverage_lookup": ["Coverage"], "dividend_eligibility_check": ["Dividend_Method"], "exclusion_exception_traverse": ["Exclusion"],
    "exclusion_full_traverse": ["Exclusion"], "surrender_value_lookup": ["Surrender_Value"], "discount_eligibility": ["Premium_Discount"],
    "regulation_lookup": ["Regulation"], "regulation_reverse_lookup": ["Regulation", "Policy"], "calculation_lookup": ["Calculation"],
    "premium_waiver_lookup": ["Coverage"], "eligibility_lookup": ["Eligibility"], "rider_lookup": ["Rider"], "dividend_portfolio_check": ["Dividend_Method"],
}
# Endings of names that mean no product in particular.
GENERIC_ENDINGS = ["보험상품", "보험 상품", "상품"]
# The words that tell which aspect a comparison is about, first template first.
ASPECTS = {
    "coverage_lookup": ["보장", "보장항목", "보험금"],
    "exclusion_exception_traverse": ["면책", "예외", "제외"],
    "dividend_eligibility_check": ["배당", "무배당"],
    "surrender_value_lookup": ["해약", "환급금", "해지"],
    "discount_eligibility": ["할인"],
    "calculation_lookup": ["계산", "계산식", "산출", "공식"],
}
PORTFOLIO, SEEDS, DIRECTION, COMPARED, CLASS_SALT = 30, 5, 3, 2, 4096


def run_template(graph: Graph, name: str, seeds: DataFrame | None = None, text: bool = False) -> DataFrame:
    """Paths of a template from all vertices of its kind, or from ``seeds`` (``id``), as ``text``
    or arrays of elements.

    The portfolio template looks at its first ``PORTFOLIO`` policies by id.
    """
    kind = "Regulation" if name == "regulation_reverse_lookup" else "Policy"
    frontier = start(graph, F.col("type") == kind, text)
    if name == "dividend_portfolio_check":
        frontier = frontier.orderBy("root").limit(PORTFOLIO)
    if seeds is not None:
        frontier = frontier.join(seeds.select(F.col("id").alias("root")).distinct(), "root", "left_semi")
    return compile_pattern(frontier, graph, TEMPLATES[name])


def classes(graph: Graph, name: str) -> tuple[DataFrame, DataFrame]:
    """``members(root, label, cls, salt)`` and ``seeds(id, cls, salts)``: a template's roots by
    their first hops.

    Roots with the same first hops have the same paths but for the root itself, so that one seed
    of each class stands for all.  Where a path may come back to the roots' type, or the graph
    does not know, each root is a class of its own.  Members of a class are dealt by ``salt``,
    ``CLASS_SALT`` to each.
    """
    first, *rest = TEMPLATES[name]
    kind = "Regulation" if name == "regulation_reverse_lookup" else "Policy"
    one = expand(start(graph, F.col("type") == kind), graph, first)
    hop = F.when(F.size("objects") > 1, F.struct(F.element_at("objects", -2)["type"].alias("type"), F.col("cur").alias("id")))
    ends = [reachable(graph, s) for s in (first, *rest)]
    own = F.lit(None).cast("string") if all(e is not None and kind not in e for e in ends) else F.col("root")
    members = one.groupBy("root").agg(F.min(F.element_at("objects", 1)["label"]).alias("label"), F.array_sort(F.collect_list(hop)).alias("hops"))
    members = members.select("root", "label", F.struct("hops", own.alias("own")).alias("cls"))
    salts = F.ceil(F.count("*") / CLASS_SALT).cast("int")
    seeds = members.groupBy("cls").agg(F.min("root").alias("id"), salts.alias("salts"))
    dealt = members.join(seeds.select("cls", "salts"), "cls").select("root", "label", "cls", F.pmod(F.xxhash64("root"), "salts").cast("int").alias("salt"))
    return dealt, seeds


def spread(rows: DataFrame, members: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows (``query_id, ...``) of the seeds for all members: ``seed, root, root_label, ...``.

    Nothing but the seeds' rows, once for each salt, and the members is shuffled.
    """
    known = rows.join(seeds.withColumnRenamed("id", "query_id"), "query_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # members first: a member's rows are made one after another
    out = members.withColumnRenamed("label", "root_label").join(known.drop("salts"), ["cls", "salt"])
    return out.withColumnRenamed("query_id", "seed").drop("cls", "salt")


def keyword_exclusions(graph: Graph, keyword: str | None) -> DataFrame:
    """Exclusions whose label contains a keyword, with their exceptions; without one, all."""
    if not keyword:
        return run_template(graph, "exclusion_full_traverse")
    steps = (_one("HAS_COVERAGE"), _one("EXCLUDED_IF", contains=keyword), _one("EXCEPTION_ALLOWED", optional=True))
    return compile_pattern(start(graph, F.col("type") == "Policy"), graph, steps)


def ordered_by_label(paths: DataFrame) -> DataFrame:
    """The paths with ``place``, each root's by their last vertex's label and id."""
    last = F.element_at("objects", -1)
    return paths.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(last["label"], last["id"])))


def discounts(graph: Graph) -> DataFrame:
    """``root, id, label, discount_rate_text, source_text`` of each policy's discounts."""
    found = run_template(graph, "discount_eligibility").select("root", F.col("cur").alias("id"))
    details = graph.vertices.where("type = 'Premium_Discount'")
    rate = F.col("discount_rate_text") if "discount_rate_text" in details.columns else F.lit(None).cast("string")
    return found.join(details, "id").select("root", "id", "label", rate.alias("discount_rate_text"), "source_text")


def representatives(graph: Graph, limit: int = 3) -> DataFrame:
    """A few policies by id, for questions without one: those of the type, else by their ids' prefix."""
    typed = graph.vertices.where("type = 'Policy'").select("id").orderBy("id").limit(limit)
    named = graph.vertices.where(F.col("id").startswith("Policy#")).select("id").orderBy("id").limit(limit)
    rank = typed.withColumn("tier", F.lit(0)).unionAll(named.withColumn("tier", F.lit(1)))
    # at most twice ``limit`` rows
    return rank.withColumn("best", F.min("tier").over(Window.partitionBy())).where("tier = best").select("id")


def neighbourhood(graph: Graph, seeds: DataFrame) -> DataFrame:
    """``root, neighbour, type``: every edge at each seed, in either direction.

    With a ``query_id`` and a ``place``, the seeds are each question's first ``SEEDS``.
    """
    if {"query_id", "place"} <= set(seeds.columns):
        seeds = seeds.where(F.col("place") <= SEEDS)
    roots = seeds.select(F.col("id").alias("root")).distinct()
    out = graph.edges.select(F.col("src").alias("root"), F.col("dst").alias("neighbour"), "type")
    back = graph.edges.select(F.col("dst").alias("root"), F.col("src").alias("neighbour"), "type")
    return out.unionAll(back).join(roots, "root", "left_semi")


def resolve_policies(graph: Graph, hits: DataFrame, limit: int = 5) -> DataFrame:
    """``hit, policy, place``: policies within three reversed hops of each hit, the first
    ``limit`` by id."""
    back = graph.edges.select(F.col("dst").alias("cur"), F.col("src").alias("up")).distinct()
    level = hits.select(F.col("id").alias("hit"), F.col("id").alias("cur")).distinct()
    found = None
    for _ in range(3):
        # distinct at each hop: many ways to a vertex count once
        level = level.join(back, "cur").select("hit", F.col("up").alias("cur")).distinct()
        part = level.where(F.col("cur").startswith("Policy#"))
        found = part if found is None else found.unionAll(part)
    ranked = found.distinct().withColumn("place", F.row_number().over(Window.partitionBy("hit").orderBy("cur")))
    return ranked.where(F.col("place") <= limit).select("hit", F.col("cur").alias("policy"), "place")


def plan(questions: DataFrame) -> DataFrame:
    """``query_id, exec_no, template, entry, keyword``: what to run for each question.

    ``questions``: ``query_id, intent, entries`` (ids of its hits, best first), ``products``
    (names in it) and ``keyword`` (an exclusion, or null).  Regulation questions go forward
    from three policies and back from three regulations, or forward from the first hit.
    Comparisons run the comprehensive template for two policies.  A dividend question without
    a particular product looks at the portfolio.  Others start from the first policy, else the
    first hit, else ``Policy#unknown``; an exclusion without keyword takes the full template,
    and a coverage question is followed by one.  A null list counts as empty.
    """
    entries = F.coalesce("entries", F.array().cast("array<string>"))
    of = lambda kind: F.filter(entries, lambda e: e.startswith(f"{kind}#"))
    policies, regulations = of("Policy"), of("Regulation")
    first = F.coalesce(F.get(policies, F.lit(0)), F.get(entries, F.lit(0)), F.lit("Policy#unknown"))
    any_ = F.array(F.coalesce(F.get(entries, F.lit(0)), F.lit("Policy#unknown")))
    run = lambda template, entry: F.struct(template.alias("template"), entry.alias("entry"))
    each = lambda ids, template: F.transform(ids, lambda e: run(F.lit(template), e))
    both = F.concat(each(F.slice(policies, 1, DIRECTION), "regulation_lookup"), each(F.slice(regulations, 1, DIRECTION), "regulation_reverse_lookup"))
    regulation = F.when(F.size(both) > 0, both).otherwise(each(any_, "regulation_lookup"))
    pair = F.slice(F.array_distinct(policies), 1, COMPARED)
    comparison = each(F.when(F.size(pair) > 0, pair).otherwise(any_), "comprehensive_lookup")
    generic = lambda p: F.coalesce(*[F.when(p.endswith(x), True) for x in GENERIC_ENDINGS], F.lit(False))
    particular = F.exists(F.coalesce("products", F.array().cast("array<string>")), lambda p: ~generic(p))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])[F.col("intent")], F.lit("coverage_lookup"))
    exclusion = F.when(F.coalesce(F.col("keyword"), F.lit("")) == "", "exclusion_full_traverse").otherwise("exclusion_exception_traverse")
    # a keyword that is given but empty filters by it, which is no filter
    main = F.when(named == "exclusion_exception_traverse", F.when(F.col("keyword").isNull(), "exclusion_full_traverse").otherwise(named)).otherwise(named)
    usual = F.concat(F.array(run(main, first)), F.when(F.col("intent") == "coverage_inquiry", F.array(run(exclusion, first))).otherwise(F.array().cast("array<struct<template:string,entry:string>>")))
    runs = (
        F.when(F.col("intent") == "regulation_inquiry", regulation).when(F.col("intent") == "policy_comparison", comparison)
        .when((F.col("intent") == "dividend_check") & ~particular, F.array(run(F.lit("dividend_portfolio_check"), F.lit(None).cast("string")))).otherwise(usual)
    )
    return questions.select("query_id", "keyword", F.posexplode(runs).alias("exec_no", "r")).select("query_id", "exec_no", "r.template", "r.entry", "keyword")


def route(intents: DataFrame) -> DataFrame:
    """``query_id, intent, template``: the template that each classified question starts from."""
    pairs = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    return intents.withColumn("template", F.coalesce(pairs[F.col("intent")], F.lit("coverage_lookup")))


def aspect(entities: Column) -> Column:
    """The template of the first aspect with a word in a comparison's entities."""
    has = lambda words: entities.rlike("|".join(words))
    return F.coalesce(*[F.when(has(words), F.lit(name)) for name, words in ASPECTS.items()], F.lit("comprehensive_lookup"))


def _branches(steps: tuple) -> list[tuple]:
    """The branches of a pattern without unions, nested optional steps beside those before them."""
    out = [()]
    for step in steps:
        parts = [b for branch in step.branches for b in _branches(branch)] if isinstance(step, Union) else [(step,)]
        out = [a + b for a in out for b in parts]
    return out


def _reaching(graph: Graph, steps: tuple, wanted: set[str] | None) -> list[tuple] | None:
    """Patterns whose paths show that a root reaches a vertex of the ``wanted`` types, or any at
    all; None where the graph does not know where a step leads."""
    found: set[tuple] = set()
    for branch in _branches(steps):
        for k, step in enumerate(branch):
            before, chain = branch[:k], ()
            while step is not None:
                here = reachable(graph, replace(step, then=None))
                if here is None:
                    return None
                chain += (replace(step, then=None, optional=False),)
                if wanted is None or here & wanted:
                    found.add(before + chain)
                step = step.then
    # a path with more required steps shows nothing that its beginning has not shown
    return [p for p in found if not any(p[:k] in found for k in range(1, len(p)))]


def _reach(graph: Graph, patterns: list[tuple], roots: DataFrame) -> DataFrame:
    """``root`` of those with a path of a pattern."""
    out = roots.where("false")
    for p in sorted(patterns, key=repr):
        out = out.unionAll(compile_pattern(start(graph, F.col("type") == "Policy", text=True), graph, p).select("root"))
    return out.distinct()


def _choices(graph: Graph, name: str, roots: DataFrame) -> DataFrame:
    """``root, chosen`` by the counts of the vertices that the template and the comprehensive one reach."""
    def reached(paths: DataFrame, n: str) -> DataFrame:
        kind = F.transform(F.filter("objects", lambda o: o["kind"] == "vertex"), lambda o: F.struct(o["id"].alias("id"), o["type"].alias("type")))
        one = paths.where(F.size("objects") > 1).select("root", F.explode(kind).alias("v"))
        return one.groupBy("root").agg(F.count_distinct("v.id").alias(n), F.max(F.col("v.type").isin(TARGETS[name])).alias(f"{n}_target"))

    seeds = roots.select(F.col("root").alias("id"))
    facts = roots.join(reached(run_template(graph, name, seeds), "a"), "root", "left").join(reached(run_template(graph, "comprehensive_lookup", seeds), "b"), "root", "left")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    better = ~F.coalesce("a_target", F.lit(False)) & (b > a)
    return facts.select("root", F.when(better, "comprehensive").when(a > 0, "primary").otherwise("neighbourhood").alias("chosen"))


def enriched(graph: Graph, name: str, text: bool = False) -> DataFrame:
    """``root, chosen, objects`` (or ``path, vertices`` as ``text``): each policy's paths of a
    template or of its fallbacks.

    The template's own where they reach one of its target types or the comprehensive ones reach
    no more vertices; else the comprehensive ones; where neither has any, the neighbourhood.

    Most policies are decided without their paths: by a path to a target type, or, where the
    comprehensive template has all branches of this one, by one to a type that this one cannot
    reach.  Vertices are counted for the others only.
    """
    roots = graph.vertices.where("type = 'Policy'").select(F.col("id").alias("root")).distinct()
    own, wide = _branches(TEMPLATES[name]), _branches(TEMPLATES["comprehensive_lookup"])
    target = _reaching(graph, TEMPLATES[name], set(TARGETS[name]))
    ends = {t for b in own for s in b for t in reachable(graph, s) or ()} | {"Policy"}
    more = _reaching(graph, TEMPLATES["comprehensive_lookup"], set(VERTEX_TYPES) - ends) if set(own) <= set(wide) else None
    facts, rest = roots.select("root", F.lit(None).cast("string").alias("chosen")), roots
    if target is not None and more is not None:
        hit = lambda patterns, tag: _reach(graph, patterns, roots).withColumn(tag, F.lit(True))
        seen = roots.join(hit(target, "t"), "root", "left").join(hit(more, "m"), "root", "left")
        facts = cut(seen.select("root", F.when(F.col("t"), "primary").when(F.col("m"), "comprehensive").alias("chosen")))
        rest = facts.where("chosen IS NULL").select("root")
    facts = facts.where("chosen IS NOT NULL")
    if not rest.isEmpty():
        facts = cut(facts.unionAll(_choices(graph, name, cut(rest))))
    of = lambda k: facts.where(F.col("chosen") == k).select(F.col("root").alias("id"))
    # a start alone is no result
    real = lambda paths: paths.where(F.col("vertices") > 1 if text else F.size("objects") > 1)
    around = (Union(((Expand(tuple(EDGE_TYPES)),), (Expand(tuple(EDGE_TYPES), reverse=True),))),)
    alone = start(graph, F.col("type") == "Policy", text).join(of("neighbourhood").withColumnRenamed("id", "root"), "root", "left_semi")
    parts = {"primary": run_template(graph, name, of("primary"), text), "comprehensive": run_template(graph, "comprehensive_lookup", of("comprehensive"), text), "neighbourhood": compile_pattern(alone, graph, around)}
    form = ["path", "vertices"] if text else ["objects"]
    out = [real(p).select("root", F.lit(k).alias("chosen"), *form) for k, p in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


def fallback(counts: DataFrame) -> DataFrame:
    """Which result a question ends with, from ``query_id, n_primary, n_comprehensive,
    n_neighbourhood, has_target``: the primary one if it has its target type or the
    comprehensive one is no larger, else that; without any node the neighbourhood."""
    better = ~F.col("has_target") & (F.col("n_comprehensive") > F.col("n_primary"))
    n = F.when(better, F.col("n_comprehensive")).otherwise(F.col("n_primary"))
    chosen = F.when(n == 0, "neighbourhood").when(better, "comprehensive").otherwise("primary")
    return counts.select("query_id", chosen.alias("chosen"), F.when(n == 0, F.col("n_neighbourhood")).otherwise(n).alias("n_nodes"))

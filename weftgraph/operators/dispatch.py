"""Dispatch resolution: what fields may point to, which members code calls, and where such chains lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import relational as R
from weftgraph.sources.tables import materialise, release

# Line rules in the order in which they are tried: pattern, field group, type group, source, confidence, languages.
_TYPE = r"(\w[\w.<>,\s|]*)"
FACT_RULES = (
    (r"(?:this|self)\s*\.\s*(\w+)\s*=\s*new\s+(\w[\w.]*)\s*\(", 1, 2, "constructor_assignment", 0.95, ()),
    (rf"(?:private|protected|public|readonly)?\s*(\w+)\s*:\s*{_TYPE}\s*[;=]", 1, 2, "field_annotation", 0.90, ()),
    (rf"constructor.*?(?:private|protected|public|readonly)\s+(\w+)\s*:\s*{_TYPE}", 1, 2, "dependency_injection", 0.92, ()),
    (r"(\w+)\s*:\s*(\w[\w.,\s|]*)\s*=\s*(?:Field|field|Column|Depends)\s*\(", 1, 2, "dataclass_attr", 0.93, ()),
    (r"self\.\s*(\w+)\s*:\s*(\w[\w.,\s|]*)\s*(?:=|$)", 1, 2, "field_annotation", 0.88, ()),
    (r"^(\w+)\s*:\s*(?:(?:Box|Arc|Rc|Mutex|RwLock|Option|Vec|HashMap|BTreeMap|Result)\s*<\s*)?(\w+)[\w<>,\s]*[,}]", 1, 2, "field_annotation", 0.90, ("rust",)),
    (r"^(?:(?:private|protected|public|internal|readonly|final|static)\s+){0,2}(?!(?:int|long|float|double|boolean|byte|char|short|void|var|string|String|return)\b)(\w[\w<>,.]*)\s+(\w+)\s*[;=]", 2, 1, "field_annotation", 0.90, ("java", "csharp")),
    (r"^(\w+)\s+\*?(\w[\w.]*)\s*(?:`|$|//)", 1, 2, "field_annotation", 0.88, ("go",)),
)
PRIMITIVES = ("null", "undefined", "void", "never", "None", "string", "number", "boolean", "any", "unknown", "int", "float", "str", "bool", "bytes", "object", "Object")
# Calls on members, and fields that get a factory's result.
CHAIN = r"(?:this|self)\s*(\.\s*\w+(?:\s*\.\s*\w+)*)\s*\("
FACTORY = r"(?:this|self)\s*\.\s*(\w+)\s*=\s*(\w[\w.]*)\s*\.\s*(\w+)\s*\("


def union_types(raw: Column) -> Column:
    """Type names of a union, without wrappers, generics and primitives."""
    strip = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(?i)^(?:Optional|Awaitable)\[(.+)\]$", "$1"), r"(?i)^Promise<(.+)>$", "$1"), r"<[^>]*>|\[.*\]", ""))
    return F.filter(F.transform(F.split(raw, r"\|"), lambda p: strip(F.trim(p))), lambda t: (t != "") & ~t.isin(*PRIMITIVES))


def points_to(symbols: DataFrame) -> DataFrame:
    """(owner, field, types, source, confidence) of code: owner, language, body. Of a line's rules the first that fits
    counts; a field keeps all types, and the source of most confidence."""
    lines = symbols.select("owner", F.lower("language").alias("language"), F.explode(F.split("body", "\n")).alias("text")).withColumn("text", F.trim("text"))
    fact = F.lit(None).cast("struct<field:string,types:array<string>,source:string,confidence:double>")
    for pattern, field, kind, source, sure, languages in reversed(FACT_RULES):
        fits = F.col("text").rlike(pattern)
        fits = fits & F.col("language").isin(*languages) if languages else fits
        made = F.struct(F.regexp_extract("text", pattern, field).alias("field"), union_types(F.trim(F.regexp_extract("text", pattern, kind))).alias("types"), F.lit(source).alias("source"), F.lit(sure).alias("confidence"))
        fact = F.when(fits, made).otherwise(fact)
    rows = lines.select("owner", fact.alias("f")).where("f IS NOT NULL AND size(f.types) > 0").select("owner", "f.*")
    best = F.max(F.struct("confidence", F.negative(F.ascii("source")).alias("order"), "source")).alias("m")
    return rows.groupBy("owner", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), best).select("owner", "field", "types", "m.source", "m.confidence")


def factory_facts(symbols: DataFrame, functions: DataFrame) -> DataFrame:
    """Facts of fields that a factory's result is assigned to. `functions` has name ("Class.method") and signature."""
    lines = symbols.select("owner", F.explode(F.split("body", "\n")).alias("text"))
    made = lines.where(F.col("text").rlike(FACTORY)).select("owner", F.regexp_extract("text", FACTORY, 1).alias("field"), F.concat_ws(".", F.regexp_extract("text", FACTORY, 2), F.regexp_extract("text", FACTORY, 3)).alias("name"))
    returns = F.coalesce(F.nullif(F.regexp_extract("signature", r"\)\s*:\s*(\w[\w.<>,\s|]*?)(?:\s*\{|$)", 1), F.lit("")), F.regexp_extract("signature", r"->\s*(\w[\w.,\s|]*?)(?:\s*:|$)", 1))
    known = functions.select("name", F.slice(union_types(returns), 1, 1).alias("types")).where("size(types) > 0")
    return made.join(known, "name").select("owner", "field", "types", F.lit("factory_return").alias("source"), F.lit(0.8).alias("confidence"))


def member_calls(symbols: DataFrame) -> DataFrame:
    """(caller, chain, method, line) of calls on this or self in functions and methods: sv_id, kind, body, start_line."""
    lines = symbols.where(F.col("kind").isin("method", "function")).select("sv_id", "start_line", F.posexplode(F.split("body", "\n")).alias("i", "text"))
    found = lines.select(F.col("sv_id").alias("caller"), (F.col("start_line") + F.col("i")).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(CHAIN), F.lit(1))).alias("part"))
    part = F.regexp_replace("part", r"\s+", "")
    return found.select("caller", F.concat(F.lit("self"), part).alias("chain"), F.substring_index(part, ".", -1).alias("method"), "line")


def resolve_chains(calls: DataFrame, facts: DataFrame, methods: DataFrame, mro: DataFrame) -> DataFrame:
    """(caller, chain, types, targets, method, confidence, is_polymorphic) of calls (caller, owner, chain).

    A segment is looked up among a type's fields, then, if it is the last, among its own methods (.9) and those of its
    ancestors (.85); confidences multiply, a segment that fails costs .7 and ends the chain, and .05 is the least. One
    join per position serves all chains, however long; each position's table is written, so that plans don't grow with
    the chains. `methods` has class, method, id; `mro` class, mro (array of classes).
    """
    segments = F.split(F.col("chain"), "[.]")
    first = calls.select("caller", "chain", F.array_compact(F.array("owner")).alias("types"), F.slice(segments, F.lit(2), F.size(segments)).alias("segments"))
    now = first.select("*", F.array().cast("array<string>").alias("targets"), F.lit("unresolved").alias("method"), F.lit(1.0).alias("confidence"), F.lit(False).alias("failed")).distinct()
    now = materialise(now, "chains")
    inherited = mro.select("class", F.posexplode("mro").alias("position", "ancestor")).join(methods.select(F.col("class").alias("ancestor"), "method", "id"), "ancestor")
    nearest = inherited.groupBy("class", "method").agg(F.min(F.struct("position", "ancestor", F.col("id").cast("string").alias("id"))).alias("m"))
    known = materialise(nearest.select("class", F.col("method").alias("segment"), F.col("m.ancestor").alias("ancestor"), F.col("m.id").alias("id"), (F.col("m.position") == 0).alias("own")), "class-methods")
    fields = facts.select(F.col("owner").alias("class"), F.col("field").alias("segment"), F.col("types").alias("field_types"), F.col("source"), F.col("confidence").alias("field_confidence"))
    fields = materialise(fields, "class-fields")
    longest = now.agg(F.max(F.size("segments"))).first()[0] or 0
    for i in range(longest):
        here = now.where((F.size("segments") > i) & ~F.col("failed"))
        rest = now.where((F.size("segments") <= i) | F.col("failed"))
        open_ = here.select("caller", "chain", F.explode_outer("types").alias("class"), F.get("segments", F.lit(i)).alias("segment"), (F.size("segments") == i + 1).alias("last"))
        met = open_.join(fields, ["class", "segment"], "left").join(known, ["class", "segment"], "left")
        by_method = F.col("last") & F.col("id").isNotNull()
        kinds = F.when(by_method & F.col("own"), "type_annotation").when(F.col("source").isNotNull(), F.col("source")).when(by_method, "inheritance_mro")
        sure = F.greatest(F.coalesce("field_confidence", F.lit(0.0)), F.when(by_method & F.col("own"), 0.9).when(by_method & F.col("source").isNull(), 0.85).otherwise(0.0))
        reached = F.concat(F.coalesce("field_types", F.array().cast("array<string>")), F.when(by_method & (F.col("own") | F.col("source").isNull()), F.array("ancestor")).otherwise(F.array().cast("array<string>")))
        hit = F.when(by_method & (F.col("own") | F.col("source").isNull()), F.col("id"))
        stepped = met.groupBy("caller", "chain").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(reached)))).alias("next"), F.array_sort(F.collect_set(hit)).alias("found"), F.max(F.struct(sure.alias("sure"), kinds.alias("kind"))).alias("m")
        )
        joined = here.join(stepped, ["caller", "chain"])
        lost = (F.size("next") == 0) & (F.size("found") == 0)
        moved = joined.select(
            "caller", "chain", F.when(lost, F.col("types")).otherwise(F.col("next")).alias("types"), "segments", F.col("found").alias("targets"), F.when(lost, "unresolved").otherwise(F.coalesce("m.kind", F.lit("unresolved"))).alias("method"),
            (F.col("confidence") * F.when(lost, 0.3).otherwise(F.col("m.sure"))).alias("confidence"), lost.alias("failed"),
        )
        stepped = materialise(rest.unionByName(moved), "chains")
        release(now)
        now = stepped
    return now.select("caller", "chain", "types", "targets", "method", F.greatest(F.lit(0.05), F.col("confidence")).alias("confidence"), (F.size("targets") > 1).alias("is_polymorphic"))


def edges_of_caller(edges: DataFrame, caller) -> DataFrame:
    return edges.where(F.col("caller") == caller).orderBy(F.desc("confidence"), "expression")


def dispatchers_of(edges: DataFrame, target) -> DataFrame:
    return edges.where(F.array_contains("resolved", F.lit(target))).orderBy(F.desc("confidence"), "caller", "expression")


def unresolved(edges: DataFrame) -> DataFrame:
    return edges.where("method = 'unresolved'").orderBy("expression", "caller")


def statistics(edges: DataFrame) -> DataFrame:
    """One row per method and one for all: edges, resolved, unresolved, polymorphic, mean confidence."""
    counts = [
        F.count(F.lit(1)).alias("edges"), F.count_if(F.size("resolved") > 0).alias("resolved"), F.count_if(F.col("method") == "unresolved").alias("unresolved"), F.count_if("is_polymorphic").alias("polymorphic"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
    ]
    return edges.agg(*counts).select(F.lit("all").alias("method"), "*").unionByName(edges.groupBy("method").agg(*counts))


def build(symbols: DataFrame, owners: DataFrame, methods: DataFrame, mro: DataFrame) -> DataFrame:
    """All dispatch edges of code: facts, calls, resolution and override chains, one row per (caller, expression). `symbols`
    has sv_id, owner, kind, language, body, start_line; `owners` caller, owner."""
    facts = points_to(symbols)
    calls = member_calls(symbols).join(owners, "caller", "left").select("caller", "owner", "chain").distinct()
    edges = resolve_chains(calls, facts, methods, mro)
    owned = mro.select("class", F.posexplode("mro").alias("position", "ancestor")).join(methods.select(F.col("class").alias("ancestor"), "method"), "ancestor")
    chain = owned.groupBy("class", "method").agg(F.array_sort(F.collect_list(F.struct("position", "ancestor"))).alias("c")).select(F.col("class").alias("owner"), F.col("method").alias("name"), F.transform("c", lambda s: s["ancestor"]).alias("override_chain"))
    named = edges.join(owners, "caller", "left").withColumn("name", F.substring_index("chain", ".", -1))
    inherits = F.col("method") == "inheritance_mro"
    return named.join(chain, ["owner", "name"], "left").select("caller", F.col("chain").alias("expression"), "types", F.col("targets").alias("resolved"), "method", "confidence", "is_polymorphic", F.when(inherits, F.col("override_chain")).alias("override_chain"))


def hierarchy_lists(hierarchy: DataFrame) -> DataFrame:
    """(class, ancestors): direct parents in order, of class, parent, position."""
    listed = F.array_sort(F.collect_list(F.struct("position", "parent")))
    return hierarchy.groupBy("class").agg(F.transform(listed, lambda s: s["parent"]).alias("ancestors"))


def best_targets(observed: DataFrame, k: int = 5) -> DataFrame:
    """(caller, resolved, calls): a caller's k most called targets."""
    total = observed.groupBy("caller", "callee").agg(F.sum("calls").alias("calls"))
    top = R.top_of_each(total, ["caller"], [F.desc("calls"), F.col("callee")], k)
    return top.groupBy("caller").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "callee"))), lambda s: s["callee"]).alias("resolved"), F.sum("calls").alias("calls"))

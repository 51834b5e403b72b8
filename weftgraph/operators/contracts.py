"""Contract mining from code bodies, signatures and decorators, and patterns across symbols.

Every rule is a Column over one row's text, so mining is one narrow pass over the distinct bodies;
only the exploded findings, which are short, are shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.rules.contract_rules import BODY_RULES, DECORATOR_RULES, REGEX_DOMAINS
from weftgraph.sources.tables import by_text, materialise

_REGEX = r"(\/(?:[^/\\]|\\.)+\/[gimsuy]*)"
_FIELD = re.compile(r"\{(\d)(?::(\d+))?\}")


def squeezed(text: Column, most: int = 120) -> Column:
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, 1, most - 3), F.lit("...")))


def filled(template: str, group) -> Column:
    """`template` with its fields; `group(i)` is the i-th group."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append(squeezed(group(int(m[1])), int(m[2])) if m[2] else group(int(m[1])))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def _gate(gate: str, body: Column, language: Column) -> Column:
    if gate.startswith("library:"):
        return reduce(lambda a, b: a | b, [body.contains(s) for s in gate[8:].split("|")])
    return F.lower(language) == gate if gate else F.lit(True)


def _finding(expression: Column, strength, source: str) -> Column:
    weight = strength if isinstance(strength, Column) else F.lit(strength)
    return F.struct(expression.alias("expression"), weight.cast("double").alias("strength"), F.lit(source).alias("source_type"))


def all_matches(text: Column, pattern: str, groups: int, make) -> Column:
    """`make(group)` for each match of a pattern."""
    if groups == 0:
        return F.when(text.rlike(pattern), F.array(make(None))).otherwise(F.array())
    lists = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(f"g{i + 1}") for i in range(groups)]
    return F.transform(F.arrays_zip(*lists), lambda m: make(lambda i: m[f"g{i}"]))


def rule_findings(body: Column, language: Column, group: str) -> list[Column]:
    out = []
    for name, gate, pattern, template, strength, source in BODY_RULES:
        if name == group:
            groups = re.compile(pattern.replace("++", "+").replace("*+", "*")).groups if _FIELD.search(template) else 0
            found = all_matches(body, pattern, groups, lambda g, t=template, s=strength, o=source: _finding(filled(t, g), s, o))
            out.append(F.when(_gate(gate, body, language), found).otherwise(F.array()) if gate else found)
    return out


def regex_domain(pattern: Column) -> Column:
    out = F.lit("custom_pattern")
    for rule, name in reversed(REGEX_DOMAINS):
        out = F.when(pattern.rlike(rule), name).otherwise(out)
    return out


def _regex_validators(body: Column) -> list[Column]:
    """`/x/.test(v)` and `v.match(/x/)`, with what the expression stands for."""

    def make(pattern: int, variable: int, verb: str, custom: float, known: float):
        def one(g):
            domain = regex_domain(g(pattern))
            text = F.concat(F.lit("regex_validation:"), g(variable), F.lit(f" {verb} "), domain, F.lit(" pattern "), squeezed(g(pattern), 80))
            return _finding(text, F.when(domain == "custom_pattern", custom).otherwise(known), "assertion")

        return one

    test = _REGEX + r"\s*\.\s*test\s*\(\s*([\w.]+)\s*\)"
    match = r"([\w.]+)\s*\.\s*match\s*\(\s*" + _REGEX + r"\s*\)"
    return [all_matches(body, test, 2, make(1, 2, "must match", 0.75, 0.85)), all_matches(body, match, 2, make(2, 1, "matched against", 0.72, 0.82))]


def _switches(body: Column) -> list[Column]:
    """A switch's variable and the cases that follow it."""
    cases = F.regexp_extract_all(body, F.lit(r"case\s+['\"`]?([\w.]+)['\"`]?\s*:"), F.lit(1))
    variables = F.regexp_extract_all(body, F.lit(r"switch\s*\(\s*([\w.]+)\s*\)\s*\{"), F.lit(1))
    tails = F.split(body, r"switch\s*\(\s*[\w.]+\s*\)\s*\{")
    after = lambda i: F.regexp_extract_all(F.array_join(F.slice(tails, i + 2, F.size(tails)), "switch "), F.lit(r"case\s+['\"`]?([\w.]+)['\"`]?\s*:"), F.lit(1))
    made = F.transform(
        variables,
        lambda v, i: F.when(
            F.size(after(i)).between(2, 50), _finding(F.concat(F.lit("enum_restriction:"), v, F.lit(" in {"), F.array_join(after(i), ", "), F.lit("}")), 0.82, "assertion")
        ),
    )
    return [F.when(F.size(cases) > 1, F.array_compact(made)).otherwise(F.array())]


def _closures(body: Column) -> list[Column]:
    """Nested functions, and the shapes of what is returned."""
    count = lambda p: F.size(F.regexp_extract_all(body, F.lit(p), F.lit(0)))
    arrows, named = count(r"(?:const|let|var)\s+\w+\s*=\s*(?:\([^)]*\)|[\w]+)\s*=>"), count(r"function\s+\w+\s*\(")
    nested = F.concat(F.lit("closure:contains "), arrows + named, F.lit(" nested function(s) ("), arrows, F.lit(" arrow, "), named, F.lit(" named)"))
    returned = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"return\s+([^;]+)"), F.lit(1)), lambda x: F.trim(x)), lambda v: v != "")
    empty = ("null", "undefined", "void 0")
    has = lambda test: F.exists(returned, test)
    nothing = has(lambda v: v.isin(*empty))
    shapes = F.array_compact(
        F.array(
            F.when(nothing, "null"), F.when(has(lambda v: v.rlike(r"^(?:new\s+)?Promise|await\s")), "Promise"), F.when(has(lambda v: v.startswith("{")), "object"),
            F.when(has(lambda v: v.startswith("[")), "array"), F.when(has(lambda v: v.isin("true", "false")), "boolean"), F.when(has(lambda v: v.rlike(r"^-?\d+(\.\d+)?$")), "number"),
        )
    )
    paths = F.size(F.regexp_extract_all(body, F.lit(r"return\s+([^;]+)"), F.lit(1)))
    shape = F.concat(F.lit("return_shape:returns "), F.array_join(shapes, " | "), F.lit(" (observed from "), paths, F.lit(" return path(s))"))
    optional = lambda when, finding: F.when(when, F.array(finding)).otherwise(F.array())
    return [
        optional(arrows + named > 0, _finding(nested, 0.65, "derived")),
        optional(F.size(shapes) > 0, _finding(shape, 0.70, "derived")),
        optional(nothing & has(lambda v: ~v.isin(*empty)), _finding(F.lit("return_nullable:function may return null/undefined on some paths"), 0.78, "derived")),
    ]


def _prisma(body: Column) -> list[Column]:
    pattern = r"(\w+)\s+(String|Int|Float|Boolean|DateTime|BigInt|Decimal|Json|Bytes)\s*(\?)?\s*(.*)"
    notes = lambda g: F.when(F.trim(g(4)) == "", F.lit("")).otherwise(F.concat(F.lit(" "), squeezed(g(4), 60)))
    return [all_matches(body, pattern, 4, lambda g: _finding(F.concat(F.lit("schema_prisma:"), g(1), F.lit(" type="), g(2), g(3), notes(g)), 0.90, "schema"))]


def _counted(body: Column, language: Column) -> list[Column]:
    """Rules that count: error propagation in Rust, guard clauses in Ruby."""
    out = []
    for name, pattern, text, strength, source in (
        ("rust", r"\w[\w.]*\s*\?", ("rust_error_propagation:", " ? operators — function returns Result/Option"), 0.80, "type_constraint"),
        ("ruby", r"return\s+(?:nil|false)?\s+(?:if|unless)\s+", ("ruby_guard_clauses:", " guard clause(s) — early return on invalid state"), 0.80, "guard_clause"),
    ):
        n = F.size(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
        out.append(F.when((F.lower(language) == name) & (n > 0), F.array(_finding(F.concat(F.lit(text[0]), n, F.lit(text[1])), strength, source))).otherwise(F.array()))
    return out


GROUPS = ("P6a", "P6b", "P6c", "P6d", "P6e", "P6f", "P6g", "P6h", "P6i", "P6j", "P6k", "P6l")


def body_findings(body: Column, language: Column, groups: tuple[str, ...] = GROUPS) -> Column:
    special = {"P6f": lambda: _regex_validators(body), "P6g": lambda: _switches(body), "P6i": lambda: _prisma(body), "P6k": lambda: _closures(body), "P6l": lambda: _counted(body, language)}
    parts = [x for g in groups for x in [*rule_findings(body, language, g), *(special[g]() if g in special else [])]]
    return F.concat(*[F.coalesce(p, F.array()) for p in parts])


def split_parameters(signature: Column) -> Column:
    """Parameters between the first and the last parenthesis, split at commas outside brackets (two deep)."""
    inside = F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)", 1)
    flat = r"[^<>()\[\]{}]"
    item = rf"(?:=>|[^,<(\[{{]|[<(\[{{]{flat}*+(?:[<(\[{{]{flat}*+[>)\]}}]{flat}*+)*+[>)\]}}])++"
    return F.filter(F.transform(F.regexp_extract_all(inside, F.lit(item), F.lit(0)), lambda x: F.trim(x)), lambda p: p != "")


_PARAMETER = r"(\w+)\s*(\?)?:\s*([^\n]+)"


def parameter_findings(signature: Column) -> Column:
    """Types of parameters, what they must be, and whether they may be missing."""

    def one(p):
        name, kind = F.regexp_extract(p, _PARAMETER, 1), F.trim(F.regexp_extract(p, _PARAMETER, 3))
        optional = F.regexp_extract(p, _PARAMETER, 2) == "?"
        must = (
            F.when(kind.isin("string", "String"), "string").when(kind.isin("number", "Number"), "number").when(kind.isin("boolean", "Boolean"), "boolean")
            .when(kind.rlike(r"\[\]$|^Array<"), "array").when(kind.rlike(r"^Promise<"), "Promise")
        )
        return F.array(
            _finding(F.concat(F.lit("input_type:"), name, F.lit(": "), squeezed(kind, 80), F.when(optional, " (optional)").otherwise("")), 0.85, "derived"),
            F.when(must.isNotNull(), _finding(F.concat(F.lit("input_contract:"), name, F.lit(" must be "), must), F.when(must.isin("array", "Promise"), 0.88).otherwise(0.90), "derived")),
            F.when(optional | kind.rlike(r"\|\s*(?:null|undefined)"), _finding(F.concat(F.lit("nullability:"), name, F.lit(" may be null/undefined")), 0.85, "derived")),
        )

    known = F.filter(split_parameters(signature), lambda p: p.rlike(_PARAMETER))
    return F.array_compact(F.flatten(F.transform(known, one)))


def return_type(signature: Column) -> Column:
    return F.trim(F.regexp_extract(signature, r"\)\s*:\s*([^\n]+?)(?:\s*\{|=>|$)", 1))


def return_findings(signature: Column) -> Column:
    kind = return_type(signature)
    inner = F.regexp_extract(kind, r"^Promise<(.+)>$", 1)
    text = lambda t: F.lit(f"output_guarantee:{t}")
    found = F.array(
        _finding(F.concat(text("returns "), squeezed(kind, 80)), 0.85, "derived"),
        F.when(inner != "", _finding(F.concat(text("async, resolves to "), squeezed(inner, 60)), 0.85, "derived")),
        F.when(kind.rlike(r"\|\s*(?:null|undefined)"), _finding(F.lit("output_nullable:return type includes null/undefined"), 0.85, "derived")),
        F.when(kind == "never", _finding(text("function always throws (return type: never)"), 0.95, "derived")),
    )
    return F.when(kind.isin("", "void", "any"), F.array()).otherwise(F.array_compact(found))


def generic_findings(signature: Column) -> Column:
    return all_matches(signature, r"<\s*(\w+)\s+extends\s+([^>,]+)", 2, lambda g: _finding(F.concat(F.lit("type_bound:"), g(1), F.lit(" extends "), squeezed(g(2), 80)), 0.82, "derived"))


def union_findings(signature: Column) -> Column:
    union = F.regexp_extract(return_type(signature), r"(\w+(?:\s*\|\s*\w+)+)", 1)
    members = F.transform(F.split(union, r"\|"), lambda x: F.trim(x))
    found = _finding(F.concat(F.lit("union_type:return is one of {"), F.array_join(members, ", "), F.lit("}")), 0.80, "derived")
    return F.when((union != "") & F.size(members).between(2, 20), F.array(found)).otherwise(F.array())


def optional_findings(signature: Column) -> Column:
    """Optional parameters, and required ones that follow them."""
    known = F.filter(split_parameters(signature), lambda p: p.rlike(_PARAMETER))
    rows = F.transform(known, lambda p: F.struct(F.regexp_extract(p, _PARAMETER, 1).alias("name"), ((F.regexp_extract(p, _PARAMETER, 2) == "?") | p.rlike(r"=\s*.+")).alias("optional")))
    first = F.array_position(F.transform(rows, lambda r: r["optional"]), F.lit(True))
    late = F.filter(rows, lambda r, i: ~r["optional"] & (first > 0) & (i >= first))
    names = F.transform(F.filter(rows, lambda r: r["optional"]), lambda r: r["name"])
    flags = F.transform(late, lambda r: _finding(F.concat(F.lit("param_ordering:required param '"), r["name"], F.lit("' follows optional params")), 0.60, "derived"))
    summary = _finding(F.concat(F.lit("optional_params:"), F.array_join(names, ", "), F.lit(" are optional")), 0.80, "derived")
    return F.concat(flags, F.when(F.size(names) > 0, F.array(summary)).otherwise(F.array()))


def decorator_findings(decorators: Column) -> Column:
    """Of an array of decorator strings."""

    def one(d):
        found = []
        for pattern, template, strength, source in DECORATOR_RULES:
            p = f"(?i){pattern}"
            found.append(F.when(d.rlike(p), _finding(filled(template, lambda i, p=p: F.regexp_extract(d, p, i)), strength, source)))
        return F.array_compact(F.array(*found))

    return F.flatten(F.transform(decorators, one))


def findings(df: DataFrame, found: Column, columns: tuple[str, ...] = ()) -> DataFrame:
    """(sv_id, expression, strength, source_type), one row per expression, the strongest. `found` reads `columns` alone, all but
    sv_id unless given."""
    keyed, texts = by_text(df, *(columns or [c for c in df.columns if c != "sv_id"]))
    each = texts.select("_text", F.explode(found).alias("f")).groupBy("_text", "f.expression").agg(F.max(F.struct("f.strength", "f.source_type")).alias("f"))
    rows = keyed.select("sv_id", "_text").join(materialise(each, "findings"), "_text").select("sv_id", "expression", "f.*")
    return rows.groupBy("sv_id", "expression").agg(F.max(F.struct("strength", "source_type")).alias("m")).select("sv_id", "expression", "m.strength", "m.source_type")


def mine(symbols: DataFrame) -> DataFrame:
    """All contracts of symbols (sv_id, body, signature, decorators, language) in one pass."""
    none = lambda c: F.coalesce(c, F.lit(""))
    body, signature, language = none(F.col("body")), none(F.col("signature")), none(F.col("language"))
    parts = [body_findings(body, language), parameter_findings(signature), return_findings(signature), generic_findings(signature), union_findings(signature), optional_findings(signature)]
    found = F.concat(*parts, decorator_findings(F.coalesce("decorators", F.array().cast("array<string>"))))
    return findings(symbols, found, ("body", "signature", "decorators", "language"))


FAMILY, GLOBAL = 3, 10


def normalised_predicate(category: Column, predicate: Column) -> Column:
    """Predicates without variable names, so that equal structures group."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    named = F.regexp_replace(predicate, r"(?i)\b[a-z_]\w*\b", "_VAR")
    guards = F.regexp_replace(F.regexp_replace(predicate, r"typeof\s+\w+", "typeof _VAR"), r"\w+\s+instanceof\s+", "_VAR instanceof ")
    return squeeze(
        F.when(category == "guard_clause", F.regexp_replace(named, r"_VAR\s*\.\s*_VAR", "_VAR._VAR"))
        .when(category == "type_guard", guards)
        .when(category.isin("null_check", "null_safety", "range_check", "length_check", "assert", "precondition"), named)
        .otherwise(predicate)
    )


def cross_symbol_patterns(invariants: DataFrame) -> DataFrame:
    """(expression, scope, strength, symbols) of assertion patterns that three or more symbols share, and again
    with global scope from ten on. `invariants` has sv_id, expression, strength, source_type."""
    rows = invariants.where("source_type = 'assertion' AND instr(expression, ':') > 0")
    category = F.substring_index("expression", ":", 1)
    predicate = F.trim(F.expr("substr(expression, instr(expression, ':') + 1)"))
    # Equal expressions are normalised once; a symbol's rows of one pattern are combined before they are shuffled.
    known = rows.select("expression").distinct().select("expression", category.alias("category"), normalised_predicate(category, predicate).alias("pattern"))
    grouped = rows.select("sv_id", "strength", "expression").join(materialise(known, "patterns"), "expression")
    shared = grouped.groupBy("category", "pattern").agg(F.countDistinct("sv_id").alias("symbols"), F.max("strength").alias("top")).where(F.col("symbols") >= FAMILY)
    boosted = F.least(F.lit(0.95), F.col("top") + 0.05 * F.log2("symbols"))
    label = F.concat("category", F.lit(":"), "pattern")
    family = F.struct(squeezed(F.concat(F.lit("family_pattern:"), label, F.lit(" (observed in "), F.col("symbols"), F.lit(" symbols)")), 500).alias("expression"), F.lit("module").alias("scope"), boosted.alias("strength"))
    whole = F.struct(
        squeezed(F.concat(F.lit("global_invariant:"), label, F.lit(" (universal pattern across "), F.col("symbols"), F.lit(" symbols)")), 500).alias("expression"),
        F.lit("global").alias("scope"), F.least(F.lit(0.98), boosted + 0.05).alias("strength"),
    )
    return shared.select("symbols", F.inline(F.array_compact(F.array(family, F.when(F.col("symbols") >= GLOBAL, whole)))))


def global_auth(handlers: DataFrame, invariants: DataFrame) -> DataFrame:
    """(handlers, authenticated, ratio, expression, strength): one row if three or more handlers (sv_id) exist and 70 % of
    them require authentication, else none."""
    asks = F.col("expression").startswith("decorator_auth:") | F.col("expression").startswith("security:") | F.col("expression").contains("requires authentication") | F.col("expression").contains("requires role")
    guarded = invariants.where(asks).select("sv_id").distinct().withColumn("guarded", F.lit(1))
    total = handlers.select("sv_id").distinct().join(guarded, "sv_id", "left").agg(F.count(F.lit(1)).alias("handlers"), F.count("guarded").alias("authenticated"))
    ratio = F.col("authenticated") / F.col("handlers")
    text = F.concat(F.lit("global_auth:"), F.round(ratio * 100).cast("int"), F.lit("% of route handlers require authentication ("), F.col("authenticated"), F.lit("/"), F.col("handlers"), F.lit(")"))
    out = total.withColumn("ratio", ratio).withColumn("expression", text).withColumn("strength", F.least(F.lit(0.95), 0.8 + F.col("ratio") * 0.15))
    return out.where("handlers >= 3 AND ratio >= 0.7")

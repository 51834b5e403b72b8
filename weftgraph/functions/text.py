"""Scalar text functions as Column expressions: tokenizers, hashes, paths, signatures, trigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, noise words and stems of the code tokenizers.
MAX_TOKEN = 256
NOISE = (
    "const", "let", "var", "function", "return", "if", "else", "for", "while", "this", "new",
    "true", "false", "null", "undefined", "import", "export", "from", "async", "await", "class",
    "interface", "type", "extends", "implements", "void", "string", "number", "boolean", "any",
    "unknown", "never", "promise",
)
STEMS = {
    "handler": "handle", "service": "serve", "manager": "manage", "factory": "factor",
    "builder": "build", "provider": "provide", "controller": "control", "validator": "valid",
    "serializer": "serial", "repository": "repo", "middleware": "middle", "resolver": "resolv",
    "adapter": "adapt", "listener": "listen", "observer": "observ", "wrapper": "wrap",
    "helper": "help", "utility": "util",
}
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
IDENTIFIER = r"[a-zA-Z_$][a-zA-Z0-9_$]*"
#: What a body loses before its identifiers are read, in this order. Literals are written as
#: unrolled loops, which Java's regex engine runs without recursion.
BODY_STRIP = (
    r"//[^\n\r]*",
    r"/\*[\s\S]*?\*/",
    r"'[^'\\]*(?:\\[^\n\r][^'\\]*)*'",
    r'"[^"\\]*(?:\\[^\n\r][^"\\]*)*"',
    r"`[^`\\]*(?:\\[^\n\r][^`\\]*)*`",
    r"\b0[xX][0-9a-fA-F]+\b",
    r"\b0[bB][01]+\b",
    r"\b0[oO][0-7]+\b",
    r"\b\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b",
)
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "pyw": "python",
    "c": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "h": "cpp", "cu": "cpp", "cuh": "cpp",
    "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "rb": "ruby", "kt": "kotlin", "kts": "kotlin",
    "swift": "swift", "php": "php", "sh": "bash", "bash": "bash",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def split_identifier(name: Column) -> Column:
    """camelCase, PascalCase and snake_case parts, in order."""
    marked = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(marked, "[_-]+"), lambda p: p != "")


def _lowered(token: Column) -> Column:
    return F.regexp_replace(F.lower(F.substring(token, 1, MAX_TOKEN)), r"\d+$", "")


def _stemmed(low: Column) -> Column:
    return F.coalesce(F.element_at(_map(STEMS), low), low)


def normalise_token(token: Column) -> Column:
    """Lower-cased, without trailing digits, stemmed; empty if shorter than two characters."""
    stem = _stemmed(_lowered(token))
    return F.when(F.length(stem) < 2, F.lit("")).otherwise(stem)


def _tokens(parts: Column, noise: bool) -> Column:
    """The parts' normal forms, all of them; one step per function, as a lambda computes again what it names twice."""
    found = F.transform(F.transform(parts, _lowered), _stemmed)
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*NOISE)) if noise else F.filter(found, lambda t: F.length(t) >= 2)


def _identifier_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    return _tokens(F.flatten(F.transform(found, split_identifier)), noise=True)


def tokenize_name(name: Column) -> Column:
    """Tokens of a symbol name; noise words stay."""
    return _tokens(split_identifier(name), noise=False)


def tokenize_body(code: Column) -> Column:
    """Identifier tokens of code without comments, string and number literals; duplicates stay."""
    stripped = code
    for pattern in BODY_STRIP:
        stripped = F.regexp_replace(stripped, pattern, "")
    return _identifier_tokens(stripped)


def tokenize_signature(signature: Column) -> Column:
    return _identifier_tokens(signature)


def tokenize_behavior(hints: Column) -> Column:
    """Tokens of an array of structs hint_type, detail."""
    return F.flatten(F.transform(hints, lambda h: F.concat(tokenize_name(h["hint_type"]), _identifier_tokens(h["detail"]))))


def tokenize_contract(inputs: Column, output: Column, thrown: Column, decorators: Column) -> Column:
    return F.flatten(F.transform(F.concat(inputs, F.array(output), thrown, decorators), _identifier_tokens))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over characters (UTF-16 units inside the basic plane)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    step = lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), step)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-cased alphanumeric words, padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of arrays taken as sets; 0 if one is empty, `both_empty` if both are."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(common / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def identity_seed(repo: Column, language: Column, kind: Column, ancestry: Column, name: Column, signature_hash: Column, path: Column) -> Column:
    zero = F.lit("\u0000")
    parts = [repo, F.lower(language), F.lower(kind), F.lower(ancestry), name, signature_hash, F.lower(path)]
    return F.sha2(F.concat(*[x for p in parts for x in (zero, p)][1:]), 256)


def signature_hash(signature: Column) -> Column:
    """16 hex digits that ignore white space and parameter names; "empty" without a signature."""
    squeezed = F.regexp_replace(F.regexp_replace(F.regexp_replace(signature, r"\s+", " "), r"\b\w+\s*:", ":"), r"\s*,\s*", ",")
    return F.when(F.coalesce(signature, F.lit("")) == "", F.lit("empty")).otherwise(F.substring(F.sha2(F.trim(squeezed), 256), 1, 16))


def _parameters(signature: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(signature, r"\(([^\n\r]*?)\)", 1), ","), lambda p: p != "")


def _type_tokens(signature: Column) -> Column:
    plain = F.lower(F.regexp_replace(signature, "[(),:]", " "))
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) > 1))


def _return_type(signature: Column) -> Column:
    return F.trim(F.element_at(F.split(signature, ":"), -1))


def signature_similarity(a: Column, b: Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    """Parameter-count ratio, equal return types and token overlap. Weights: (.4, .4, .2) between
    candidates, (.4, .3, .3) for lineage."""
    pa, pb = F.size(_parameters(a)), F.size(_parameters(b))
    most = F.greatest(pa, pb)
    count = F.when(most == 0, F.lit(weights[0])).otherwise(weights[0] * F.least(pa, pb) / most)
    returns = F.when((_return_type(a) == _return_type(b)) & (_return_type(a) != ""), F.lit(weights[1])).otherwise(0.0)
    ta, tb = _type_tokens(a), _type_tokens(b)
    score = F.least(F.lit(1.0), count + returns + weights[2] * jaccard(ta, tb))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(score)


def lineage_name_tokens(name: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2")
    return F.array_distinct(F.filter(F.split(F.lower(marked), r"[_\-\s.]+"), lambda p: p != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """The better of edit similarity and token overlap."""
    edit = 1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b))
    tokens = jaccard(lineage_name_tokens(a), lineage_name_tokens(b))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(edit, tokens))


def dirname(path: Column) -> Column:
    """All before the last slash; empty without one or if it comes first."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def ancestry(stable_key: Column) -> Column:
    """The dotted parents of the symbol part, which follows the first "::", else the first "#"."""
    part = F.when(F.instr(stable_key, "::") > 0, F.regexp_extract(stable_key, r"(?s)^.*?::(.*)$", 1)).otherwise(F.regexp_extract(stable_key, r"(?s)^[^#]*#(.*)$", 1))
    return F.when(F.instr(part, ".") > 0, F.regexp_replace(part, r"\.[^.]*$", "")).otherwise(F.lit(""))


def simple_name(name: Column) -> Column:
    last = F.regexp_extract(name, r"([^.:#/]*)$", 1)
    return F.when(last == "", name).otherwise(last)


def portable_path(path: Column) -> Column:
    """Forward slashes, no leading "./", and without the first build or source prefix that applies."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", ""), "//", "/")
    out = plain
    for name in ("src", "build", "dist", "node_modules"):
        cut = F.regexp_replace(plain, f"^[^\\n]*?/{name}/", "")
        out = F.when((cut != "") & (cut != plain), cut).otherwise(out)
    return out


# Wrapper names that compilers and bundlers add.
WRAPPERS = (
    r"^_(?:classCallCheck|createClass|possibleConstructorReturn|inherits)$",
    r"^__(?:awaiter|generator|decorate|param|metadata|asyncGenerator|asyncDelegator|asyncValues|rest|spread|spreadArrays)$",
)


def demangle(name: Column) -> Column:
    """A compiled name's source form; the name itself if nothing resolvable is left."""
    bare = F.regexp_replace(name, r"__WEBPACK_IMPORTED_MODULE_\d+__", "")
    for pattern in WRAPPERS:
        bare = F.regexp_replace(bare, pattern, "")
    out = reduce(lambda c, p: F.regexp_replace(c, p, ""), (r"[$_]\d+$", r"^bound\s+", r"^async\s+"), bare)
    return F.when(F.length(bare) <= 1, name).when(out.rlike(r"^[<(]anonymous[>)]$"), name).otherwise(out)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


CONTEXT_MARK, CAPSULE_MARK = "\n/* truncated to context token budget */", " /* truncated */"


def fit_to_budget(text: Column, tokens: Column, mark: str = CONTEXT_MARK) -> Column:
    """The text cut to a token budget, with a mark where it fits."""
    room = (tokens * 4).cast("int")
    cut = F.when(room <= len(mark), F.substr(text, F.lit(1), room)).otherwise(F.concat(F.substr(text, F.lit(1), room - len(mark)), F.lit(mark)))
    return F.when(tokens <= 0, F.lit("")).when(token_estimate(text) <= tokens, text).otherwise(cut)


def loose_hash(text: Column, language: Column) -> Column:
    """SHA-256 of code without comments and block strings, white space squeezed."""
    plain = F.regexp_replace(text, r"//[^\n]*", "")
    plain = F.when(language.isin("python", "ruby"), F.regexp_replace(plain, r"#[^\n]*", "")).otherwise(plain)
    for pattern in (r"(?s)/\*.*?\*/", r'(?s)""".*?"""', r"(?s)'''.*?'''"):
        plain = F.regexp_replace(plain, pattern, "")
    return F.sha2(F.trim(F.regexp_replace(plain, r"\s+", " ")), 256)


def language_of(path: Column) -> Column:
    """By the file extension; null if unknown."""
    return F.element_at(_map(LANGUAGES), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


# Commit subjects.
BUG_FIX = (r"\bfix(?:e[sd])?\b", r"\bbug\b", r"\bpatch\b", r"\bhotfix\b", r"\bresolve[sd]?\b", r"\bclose[sd]?\s+#\d+", r"\bregression\b")
REVERT, MERGE = r"^revert\b", r"^merge\s+(branch|pull\s+request|remote)"


def is_bug_fix(subject: Column) -> Column:
    return F.lower(subject).rlike("|".join(BUG_FIX))


def is_revert(subject: Column) -> Column:
    return F.lower(subject).rlike(REVERT)


def is_merge(subject: Column) -> Column:
    return F.lower(subject).rlike(MERGE)


# Paths that history analysis leaves out.
BINARY = (
    "png jpg jpeg gif ico svg webp bmp woff woff2 ttf eot otf zip tar gz bz2 7z rar exe dll so dylib bin "
    "pdf doc docx xls xlsx ppt pptx mp3 mp4 avi mov wav pyc pyo class o obj"
).split()
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", "Cargo.lock", "poetry.lock", "go.sum")
BUILD_DIRS = ("node_modules/", "dist/", "build/", ".git/", "__pycache__/", ".tox/")


def is_ignored_path(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    inside = reduce(lambda a, b: a | b, [path.contains(d) for d in BUILD_DIRS])
    return extension.isin(*BINARY) | F.regexp_extract(path, r"([^/]*)$", 1).isin(*LOCKFILES) | inside


def quantified_complex_group(pattern: str) -> bool:
    """Whether a pattern repeats a group that itself repeats or alternates, so that it may backtrack badly."""
    opened: list[list[bool]] = []
    escaped = in_class = False
    for i, c in enumerate(pattern):
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            for group in opened:
                group[0] = group[0] or len(opened) > 0
            opened.append([False])
        elif c == ")" and opened:
            group = opened.pop()
            if group[0] and pattern[i + 1 : i + 2] in ("+", "*", "{"):
                return True
        elif c in "|+*?{" and opened:
            opened[-1][0] = True
    return False


def search_predicate(line: Column, pattern: str) -> Column:
    """Case-insensitive match; patterns that may backtrack badly are searched literally."""
    if quantified_complex_group(pattern):
        return F.contains(F.lower(line), F.lit(pattern.lower()))
    return line.rlike(f"(?i){pattern}")

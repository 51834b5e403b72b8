"""Code files to symbols, relations, contracts and module-resolved effect hints.

Python files are parsed by the standard library; other languages by declarations found in text
that has lost its literals and comments. A file is one row and is handled where it is read.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.effects import blank_literals
from weftgraph.rules import module_effects as M
from weftgraph.sources.tables import spread

RECORD = """record string, key string, name string, kind string, visibility string, start_line int, end_line int, signature string, body string, relation_type string, target string,
  input_types array<string>, output_type string, thrown_types array<string>, decorators array<string>"""
_COLUMNS = [c.strip().split(" ")[0] for c in RECORD.split(",")]


def _row(record: str, key: str, **values) -> dict:
    return dict.fromkeys(_COLUMNS) | {"record": record, "key": key} | values


def _name_of(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except Exception:
        return ""


def python_records(path: str, text: str) -> list[dict]:
    """Records of one Python file; a file that does not parse gives none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [_row("error", path, name="parse_error")]
    out: list[dict] = []

    def visit(node: ast.AST, owner: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{owner}.{child.name}" if owner else child.name
                key, is_class = f"{path}#{name}", isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                decorators = [f"@{_name_of(d)}" for d in child.decorator_list]
                args = "" if is_class else _name_of(child.args)
                returns = "" if is_class or child.returns is None else _name_of(child.returns)
                signature = f"class {child.name}" if is_class else f"{child.name}({args})" + (f" -> {returns}" if returns else "")
                visibility = "private" if child.name.startswith("_") and not child.name.startswith("__") else "public"
                out.append(_row("symbol", key, name=name, kind=kind, visibility=visibility, start_line=child.lineno, end_line=child.end_lineno, signature=signature, body=ast.get_source_segment(text, child) or ""))
                if is_class:
                    out.extend(_row("relation", key, relation_type="inherits", target=_name_of(b)) for b in child.bases)
                else:
                    thrown = sorted({_name_of(n.exc.func if isinstance(n.exc, ast.Call) else n.exc) for n in ast.walk(child) if isinstance(n, ast.Raise) and n.exc is not None})
                    types = [_name_of(a.annotation) for a in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs] if a.annotation is not None]
                    out.append(_row("contract", key, input_types=types, output_type=returns or "void", thrown_types=thrown, decorators=decorators))
                    out.extend(_row("relation", key, relation_type="calls", target=_name_of(n.func)) for n in ast.walk(child) if isinstance(n, ast.Call))
                visit(child, name, is_class)
            elif isinstance(child, ast.Import):
                out.extend(_row("relation", path, relation_type="imports", target=a.name) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.extend(_row("relation", path, relation_type="imports", target=f"{child.module or ''}.{a.name}") for a in child.names)
            else:
                visit(child, owner, in_class)

    visit(tree, "", False)
    return out


#: Declarations: languages (empty: all others), kind, pattern with groups name and, for functions, args and out.
DECLARATIONS = (
    ((), "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|abstract\s+|final\s+|sealed\s+|data\s+|open\s+)*(?:class|struct|trait|object)\s+(?P<name>\w+)"),
    ((), "interface", r"^\s*(?:export\s+|public\s+)?(?:interface|protocol)\s+(?P<name>\w+)"),
    (("typescript", "javascript", "php", "bash"), "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)(?:\s*:\s*(?P<out>[^{;=]+))?"),
    (("typescript", "javascript"), "function", r"^\s*(?:export\s+)?const\s+(?P<name>\w+)\s*=\s*(?:async\s*)?\((?P<args>[^)]*)\)(?:\s*:\s*(?P<out>[^=]+?))?\s*=>"),
    (("typescript", "javascript", "java", "csharp", "cpp"), "method", r"^\s+(?:(?:public|private|protected|static|async|override|readonly|final|virtual|abstract)\s+)*(?:[\w<>\[\],.]+\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b)(?P<name>\w+)\s*\((?P<args>[^)]*)\)(?:\s*:\s*(?P<out>[^{;]+))?\s*(?:throws\s+[\w,\s]+)?\{"),
    (("go",), "function", r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*\((?P<args>[^)]*)\)\s*(?P<out>[^{]*)\{"),
    (("rust",), "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)(?:\s*->\s*(?P<out>[^{;]+))?"),
    (("ruby",), "method", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)\s*(?:\((?P<args>[^)]*)\))?"),
    (("kotlin", "swift"), "function", r"^\s*(?:\w+\s+)*(?:fun|func)\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)(?:\s*(?::|->)\s*(?P<out>[^{=]+))?"),
)
_CALL = re.compile(r"\b(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|fn\b|func\b|fun\b|def\b|new\b)([A-Za-z_][\w.:]*)\s*\(")
_IMPORT = re.compile(r"""(?m)^\s*(?:import\b.*?from\s+['"]([^'"]+)['"]|import\s+['"]([^'"]+)['"]|(?:import|using|use|require|#include|package)\s+["'<]?([\w./:*@-]+))""")
_PARENT = re.compile(r"(?:extends|implements|:|<)\s*([\w.]+)")
_THROW = re.compile(r"(?:throw\s+new|raise|throw)\s+([A-Z]\w*)")


def text_records(path: str, text: str, language: str) -> list[dict]:
    """Records of one file in another language, by declarations; a body ends where its braces, or the file, do."""
    out: list[dict] = [_row("relation", path, relation_type="imports", target=next(g for g in m.groups() if g)) for m in _IMPORT.finditer(text)]
    lines, owner, owner_end = text.split("\n"), "", -1
    rules = [(kind, re.compile(p)) for langs, kind, p in DECLARATIONS if not langs or language in langs]
    marks: list[str] = []
    for i, line in enumerate(lines):
        if line.strip().startswith("@"):
            marks.append(line.strip())
            continue
        kind, m = next(((k, m) for k, r in rules if (m := r.match(line))), (None, None))
        if m is None:
            marks = marks if not line.strip() else []
            continue
        depth, end, seen = 0, i, False
        for j in range(i, len(lines)):
            depth += lines[j].count("{") - lines[j].count("}")
            seen = seen or "{" in lines[j]
            end = j
            if (seen and depth <= 0) or (not seen and language == "ruby" and lines[j].strip() == "end"):
                break
        groups = m.groupdict()
        inside = i <= owner_end and owner
        name = f"{owner}.{groups['name']}" if inside and kind not in ("class", "interface") else groups["name"]
        key, body = f"{path}#{name}", "\n".join(lines[i : end + 1])
        kind = "method" if inside and kind == "function" else kind
        out.append(_row("symbol", key, name=name, kind=kind, visibility="private" if re.search(r"\bprivate\b", line) else "public", start_line=i + 1, end_line=end + 1, signature=line.strip().rstrip("{").strip(), body=body))
        if kind in ("class", "interface"):
            owner, owner_end = groups["name"], end
            out.extend(_row("relation", key, relation_type="inherits", target=p) for p in _PARENT.findall(line.split(groups["name"], 1)[1]))
        else:
            types = [a.split(":")[-1].strip().split("=")[0].strip() for a in (groups.get("args") or "").split(",") if a.strip()]
            out.append(_row("contract", key, input_types=types, output_type=(groups.get("out") or "void").strip() or "void", thrown_types=sorted(set(_THROW.findall(body))), decorators=marks))
            out.extend(_row("relation", key, relation_type="calls", target=c) for c in _CALL.findall(body.split("{", 1)[-1] if "{" in body else body))
        marks = []
    return out


def extract(files: DataFrame) -> DataFrame:
    """Records of files (path, language, text), of kinds symbol, relation, contract and error; pages of rows stay bounded because
    files are."""
    from weftgraph.sources.ship import ship

    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, text in zip(pdf["path"], pdf["language"], pdf["text"], strict=True):
                found = python_records(path, text or "") if language == "python" else text_records(path, text or "", language or "")
                rows += [r | {"path": path, "language": language} for r in found]
            yield pd.DataFrame(rows, columns=["path", "language", *_COLUMNS]).astype({"start_line": "Int32", "end_line": "Int32"})

    return spread(files.select("path", "language", "text"), "path").mapInPandas(run, f"path string, language string, {RECORD}")


def symbols(records: DataFrame) -> DataFrame:
    return records.where("record = 'symbol'").select("path", "language", "key", "name", "kind", "visibility", "start_line", "end_line", "signature", "body")


def relations(records: DataFrame) -> DataFrame:
    """Distinct (key, target, relation_type)."""
    return records.where("record = 'relation'").select("key", "target", "relation_type").distinct()


def contracts(records: DataFrame) -> DataFrame:
    return records.where("record = 'contract'").select("key", "input_types", "output_type", "thrown_types", "decorators")


def parse_confidence(errors: Column, nodes: Column) -> Column:
    return F.round(F.when(errors == 0, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - 5.0 * errors / nodes)), 2)


def module_of(specifier: Column) -> Column:
    """"node:fs/promises" is fs, "@scope/name/x" is @scope/name."""
    plain = F.regexp_replace(specifier, "^node:", "")
    return F.when(plain.startswith("@"), F.regexp_extract(plain, "^(@[^/]+(?:/[^/]+)?)", 1)).otherwise(F.substring_index(plain, "/", 1))


_BOUND = r"""(?m)(?:import\s+(?:\*\s+as\s+)?(\w+)\s+from\s+['"]([^'"]+)['"]|(?:const|let|var)\s+(\w+)\s*=\s*require\(\s*['"]([^'"]+)['"]\s*\))"""
_NAMED = r"""(?m)import\s*\{([^}]*)\}\s*from\s+['"]([^'"]+)['"]"""
_CALLED = r"(?<![\w.])(?:new\s+)?(\w+)((?:\.\w+)*)\s*\(\s*(?:['\"`]([^'\"`]*))?"


def resolved_hints(files: DataFrame) -> DataFrame:
    """(path, hint_type, detail, line) of calls in scripts (path, text) whose root is imported from a known module, or is a known
    global that nothing in the file redefines. The rule table is small and fixed, so it is broadcast."""
    spark = files.sparkSession
    zipped = lambda text, pattern, *groups: F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)])
    single = files.select("path", F.explode(zipped(F.col("text"), _BOUND, 1, 2, 3, 4)).alias("b")).select("path", F.concat("b.g0", "b.g2").alias("root"), F.concat("b.g1", "b.g3").alias("spec"))
    several = files.select("path", F.explode(zipped(F.col("text"), _NAMED, 1, 2)).alias("b")).select("path", F.explode(F.split("b.g0", ",")).alias("n"), F.col("b.g1").alias("spec"))
    several = several.select("path", F.regexp_extract(F.trim("n"), r"(\w+)$", 1).alias("root"), "spec")
    local = F.concat(F.regexp_extract_all("text", F.lit(r"(?:const|let|var|function|class)\s+(\w+)"), F.lit(1)), F.array().cast("array<string>"))
    globals_ = files.select("path", local.alias("own")).select("path", "own", F.explode(F.array(*map(F.lit, M.GLOBALS))).alias("root")).where(~F.array_contains("own", F.col("root")))
    bound = single.union(several).select("path", "root", module_of(F.col("spec")).alias("module")).union(globals_.select("path", "root", F.concat(F.lit("global:"), "root"))).distinct()
    table = spark.createDataFrame([(k, *v) for k, v in M.MODULES.items()] + [(f"global:{k}", *v) for k, v in M.GLOBALS.items()], "module string, class string, label string")
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    calls = lines.where(~F.col("line").rlike(r"^\s*import\b")).select("path", (F.col("i") + 1).alias("line"), F.explode(zipped(F.col("line"), _CALLED, 1, 2, 3)).alias("c")).select("path", "line", F.col("c.g0").alias("root"), F.regexp_replace("c.g1", r"^.*\.", "").alias("member"), F.col("c.g2").alias("argument"))
    hit = calls.join(bound, ["path", "root"]).join(F.broadcast(table), "module")
    m, label = F.col("member"), F.col("label")
    named = lambda member: F.concat(label, F.lit("."), member)
    db = (
        F.when(F.col("argument").rlike(M.SQL_TXN), "transaction").when(F.col("argument").rlike(M.SQL_WRITE), "db_write").when(F.col("argument").rlike(M.SQL_READ), "db_read").when(m.isin("transaction", "$transaction"), "transaction")
        .when(m.rlike(M.DB_WRITE), "db_write").otherwise("db_read")
    )
    kind = F.when(F.col("class") == "db", db).when(F.col("class") == "file", "file_io").otherwise(F.col("class"))
    file_detail = F.when(F.coalesce(F.nullif(m, F.lit("")), F.col("root")).rlike(M.FILE_WRITE), "write_file").when(F.coalesce(F.nullif(m, F.lit("")), F.col("root")).rlike(M.FILE_READ), "read_file").otherwise(F.concat(label, F.lit("_operation")))
    detail = (
        F.when(F.col("class") == "file", file_detail).when(F.col("class") == "db", named(F.when(m == "", "call").otherwise(m))).when(F.col("module").startswith("global:") | (m == ""), label).otherwise(named(m))
    )
    return hit.select("path", kind.alias("hint_type"), detail.alias("detail"), "line")


def code_only(files: DataFrame) -> DataFrame:
    return files.withColumn("text", blank_literals(F.col("text"), F.col("language")))

"""Queries that SQL can't express against plain versions over the whole tables."""

import hashlib
import re
from pathlib import Path

import pytest

from weftgraph.functions import code as K
from weftgraph.operators import dispatch as D
from weftgraph.operators import families
from weftgraph.operators.lifecycle import MAX_PER_REPO
from weftgraph.plans import bindings as B
from weftgraph.plans import catalogue, evidence, homologs, lifecycle


def rows(spark, small, name):
    return catalogue.QUERIES[name](spark, small).collect()


def test_file_walk(spark, small):
    want = {(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(small).rglob("*") if p.is_file() and p.stat().st_size <= 1_000_000}
    assert {tuple(r) for r in rows(spark, small, "S1_file_walk")} == want


def test_blanked_literals(spark, small):
    bodies = {r.sv_id: r for r in B.bodies(spark, small).collect()}
    got = {r.sv_id: r.code for r in rows(spark, small, "C8_blanked_literals")}
    assert got.keys() == bodies.keys()
    for i, code in got.items():
        body = bodies[i].body
        assert len(code) == len(body)
        assert all(c == b or c == " " for c, b in zip(code, body, strict=True))
        assert [m.start() for m in re.finditer("\n", code)] == [m.start() for m in re.finditer("\n", body)]
        if not re.search(r"""["'`#/]""", body):
            assert code == body


def test_shape_hash(spark, small):
    bodies = {r.sv_id: r.body for r in B.bodies(spark, small).collect()}
    got = {r.sv_id: r.shape_hash for r in rows(spark, small, "C9_shape_hash")}
    want = {b: hashlib.sha256(K.shape(b).encode()).hexdigest() for b in set(bodies.values())}
    assert got == {i: want[b] for i, b in bodies.items()}
    padded = {b: hashlib.sha256(K.shape(b.replace("\n", "  \n ")).encode()).hexdigest() for b in want}
    assert padded == want


def walk(owner, segments, fields, mros, methods):
    """One chain, segment by segment: types, targets, how and how sure."""
    types, targets, how, sure = {owner}, set(), "unresolved", 1.0
    for i, name in enumerate(segments):
        last, reached, hit, best = i == len(segments) - 1, set(), set(), []
        for t in types:
            field = fields.get((t, name))
            at = next((k for k, c in enumerate(mros.get(t, [])) if (c, name) in methods), None) if last else None
            if field:
                reached |= set(field[0])
            if at == 0:
                best.append((max(0.9, field[2] if field else 0.0), "type_annotation"))
            elif field:
                best.append((field[2], field[1]))
            elif at is not None:
                best.append((0.85, "inheritance_mro"))
            if at == 0 or (at is not None and not field):
                c = mros[t][at]
                reached.add(c)
                hit.add(str(methods[c, name]))
        targets = hit
        if not reached and not hit:
            return types, targets, "unresolved", sure * 0.3
        types, (s, how) = reached, max(best)
        sure *= s
    return types, targets, how, sure


@pytest.fixture(scope="module")
def chains(spark, small):
    code, methods, mro = evidence._world(spark, small)
    fields = {(r.owner, r.field): (r.types, r.source, r.confidence) for r in D.points_to(code).collect()}
    mros, known = {r["class"]: r["mro"] for r in mro.collect()}, {(r["class"], r.method): r.id for r in methods.collect()}
    calls = {(r.caller, r.chain) for r in D.member_calls(code).collect()}
    owner, out = {r.sv_id: r.owner for r in code.collect()}, {}
    for caller, chain in calls:
        types, targets, how, sure = walk(owner[caller], chain.split(".")[1:], fields, mros, known)
        out[caller, chain] = (",".join(sorted(types)), ",".join(sorted(targets)), how, round(max(0.05, sure), 9), len(targets) > 1)
    return out, mros, known, owner


def test_chain_resolution(spark, small, chains):
    got = {(r.caller, r.chain): (r.types, r.targets, r.method, round(r.confidence, 9), r.is_polymorphic) for r in rows(spark, small, "D3_chain_resolution")}
    assert got == chains[0]
    assert {"unresolved", "inheritance_mro"} <= {v[2] for v in got.values()}


def test_dispatch_build(spark, small, chains):
    want, mros, methods, owner = chains
    got = rows(spark, small, "D4f_dispatch_build")
    assert {(r.caller, r.expression): (r.types, r.resolved, r.method, round(r.confidence, 9), r.is_polymorphic) for r in got} == want
    for r in got:
        name = r.expression.rpartition(".")[2]
        above = ",".join(c for c in mros[owner[r.caller]] if (c, name) in methods)
        assert r.override_chain == (above if r.method == "inheritance_mro" else None)


def test_bisection(spark, small):
    """Parts cover their component, which is split only if it is large or sparse, as the plain search splits it."""
    members, links = homologs._families(spark, small)
    of = {r.member: r.family for r in members.collect()}
    inside: dict = {}
    for r in links.collect():
        inside.setdefault(of[r.a], []).append((r.a, r.b, r.confidence))
    want = {(f, m) for m, f in of.items()}
    for family, own in inside.items():
        size = sum(1 for f in of.values() if f == family)
        if size > families.SPLIT_OVER or sum(w for _, _, w in own) / len(own) < families.DENSITY:
            near: dict = {}
            for a, b, w in own:
                near.setdefault(a, {})[b] = w
                near.setdefault(b, {})[a] = w
            parts = families.bisect(list(near), near)
            assert sorted(m for p in parts for m in p) == sorted(m for m, f in of.items() if f == family)
            want = {x for x in want if x[0] != family} | {(min(p), m) for p in parts for m in p}
    assert {(r.family, r.member) for r in rows(spark, small, "G8_bisection")} == want


def test_greedy_assignment(spark, small):
    pairs = homologs._renames(spark, small).select("new_id", "old_id", "score").collect()
    new, old, want = set(), set(), set()
    for r in sorted(pairs, key=lambda r: (-r.score, r.new_id, r.old_id)):
        if r.new_id not in new and r.old_id not in old:
            new.add(r.new_id)
            old.add(r.old_id)
            want.add((r.new_id, r.old_id, r.score))
    assert {(r.new_id, r.old_id, r.score) for r in rows(spark, small, "L2_greedy_assignment")} == want and want


def test_policy_run(spark, small, duck):
    count = lambda sql: duck.execute(f"SELECT count(*) FROM {sql}").fetchone()[0]
    of = lambda name: f"({catalogue.ORACLES[name]})"
    over = f"(SELECT row_number() OVER (PARTITION BY repo ORDER BY created_at DESC) AS rn FROM {lifecycle._SNAPS}) WHERE rn > {MAX_PER_REPO}"
    want = {"stuck": count(f"{of('Z9c_stuck')} WHERE index_status = 'failed'"), "stale": count(f"({lifecycle._STALE})"), "expiry": count(of("Z9a_expired")), "cap": count(over), "orphans": count(of("Z9e_orphan_backups"))}
    got = rows(spark, small, "Z9f_policy_run")
    assert [r.step for r in got] == list(want)
    assert {r.step: r.rows for r in got} == want and not any(r.error for r in got)

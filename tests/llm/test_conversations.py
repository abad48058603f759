import hashlib
import itertools
import random
import re

import pytest
from brute import SF, crc32

from corpusgraph.llm import conversations as C
from corpusgraph.llm import queries

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, same string, part long"


def damage(rows):
    """Rows after damage, by plain reading of the contract; rows of one turn in the operator's stated order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    mark = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, mark(r)))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit, repaired lines), suffix by suffix, over tuples."""
    marks, n = faults(rows), len(rows)
    step = lambda state, c: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(c)
    best = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        plain = {}
        for state in ("", "s", "u", "a"):
            offers = []
            if i == n:
                offers += [(0, "", ())] if state in ("", "a") else []
            else:
                _, role, text = rows[i]
                after = best[i + 1]
                c, a, t = after[state]
                offers.append((c + 4, "D" + a, t))
                if marks[i] in ("", "t"):
                    extra = 3 * (marks[i] == "t")
                    for letter, name, paid in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                        to = step(state, name[:1])
                        if to:
                            c, a, t = after[to]
                            offers.append((c + paid + extra, letter + a, (f"{name}:{text}", *t)))
            plain[state] = offers
        for state in plain:
            offers, at, put = list(plain[state]), state, ()
            for k in (1, 2, 3):
                name = "assistant" if at == "u" else "user"
                at, put = name[0], (*put, f"{name}:")
                offers += [(c + 3 * k, "I" * k + a, put + t) for c, a, t in plain[at]]
            best[i][state] = min(offers)
    return best[0][""]


def report(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = []
    for conv, group in by.items():
        kept = damage(group)
        marks, turns = faults(kept), {t for t, _, _ in kept if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, lines = cheapest(kept)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    got = C.repair_report(C.damaged(df), copies="copies")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_conversations(spark, SF).collect()), key=repr) == report(rows)


def test_odd_rows(spark):
    """Nulls anywhere, ties, repeats, other roles, a long conversation over many tasks, clashing extra columns."""
    rng = random.Random(5)
    texts = ["Yes.", "yes", "No!", "", None, " \t\n", "a.\x0b", " ", "héllo? ", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "agent", "u"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(700)]
    rows += [(77, i, rng.choice(roles[:3]), f"{i % 90} said" + rng.choice(".x")) for i in range(900)] + [(78, 1, "user", "Same.")] * 200
    rows += [(79, None, "assistant", "So."), (80, -(2**62), "user", "Far."), (80, 2**62, "assistant", "Off.")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    assert run(df.repartition(5)) == report(rows)
    assert run(df.limit(0)) == []


def test_every_audit_of_short_conversations():
    """The integer minimum is the least of all edit sequences, told one by one."""
    rng = random.Random(2)
    for _ in range(60):
        rows = [(i, rng.choice(["user", "assistant", "system", "x"]), rng.choice([f"{i}.", f"{i}", ""])) for i in range(rng.randrange(4))]
        marks, found = faults(rows), []
        for letters in itertools.product("DKR", repeat=len(rows)):
            for puts in itertools.product(range(3), repeat=len(rows) + 1):
                cost, said, audit = 3 * sum(puts), "", ""
                for i, n in enumerate(puts):
                    said, audit = said + "?" * n, audit + "I" * n
                    if i < len(rows):
                        audit += letters[i]
                        if letters[i] == "D":
                            cost += 4
                        else:
                            cost += (1 << 40) * (marks[i] in ("b", "d")) + 3 * (marks[i] == "t") + 3 * (letters[i] == "R")
                            said += rows[i][1][0] if letters[i] == "K" else "?"
                options = [("s" if k else "") + "ua" * ((len(said) - k) // 2) for k in (0, 1)]
                ok = any(len(o) == len(said) and o != "s" and all(x == y or (x == "?" and y != "s") for x, y in zip(said, o, strict=True)) for o in options)
                if ok:
                    found.append((cost, audit))
        product = C.Product()
        for (_, role, _), mark in zip(rows, marks, strict=True):
            product.add(C.Stretch(C.row_table(role[:1], {"": C.FINE, "t": C.TRUNCATED, "b": C.BLANK, "d": C.DUPLICATE}[mark]), C.SLOT))
        assert C.cheapest(product.value()) == min(found)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 501])
def test_products_do_not_depend_on_their_cuts(size):
    rng = random.Random(size)
    tables = [C.Stretch(C.row_table(rng.choice("suax"), rng.randrange(4)), C.SLOT) for _ in range(501)]
    whole, cut = C.Product(), C.Product()
    for t in tables:
        whole.add(t)
    for i in range(0, len(tables), size):
        part = C.Product()
        for t in tables[i : i + size]:
            part.add(t)
        cut.add(part.value())
    assert whole.value().table == cut.value().table


def test_repaired_messages(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "system", "Cut"), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plans = C.plan_repairs(df)
    made = {}
    for r in C.repaired(df, plans).collect():
        made.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    audits = {r["conv_id"]: r["audit"] for r in plans.collect()}
    assert "".join(e for e, _, _ in made[1][1:]) == audits[1] and made[2] == [(None, None, None), ("D", "user", "")]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for e, r, _ in made[1] if e not in (None, "D")))

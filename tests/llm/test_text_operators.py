"""Personal data, importance resampling and conversation repair against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from veldspar.llm import conversations, crc, kernel, pii, resample
from veldspar.llm.queries import queries

# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None,
                "card": 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def own_spans(text):
    return [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@._%+-1 4(é", max_size=40))
def test_addresses_and_numbers_match_their_patterns(text):
    assert own_spans(text) == plain_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["1.2.3.4", "300", "255", "0255", ".", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", " ", "-", "+", "+1 (555) 010-2030", "x@y.z", "b@c", "@", ".d", "é"]), max_size=12))
def test_joined_values_match_their_patterns(parts):
    assert own_spans("".join(parts)) == plain_spans("".join(parts))


def test_long_runs_take_time_in_proportion():
    n = 300_000
    for text in ("a" * n, "1" * n, "1." * n, "+" * n, "+1" + "-" * n, "a@" * n, "@" * n, "a.b" * n + "@", "1 " * n, "1" * n + ".1.1.1", "x@" + "-" * n, "+1 2" * n):
        pii.base_spans(text)


def plain_terms(rows, reach=10, support=3, least=0.85):
    """spans of terms by document, one document after another."""
    word = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    n_t, total, c, both, marks, entity_marks, of = Counter(), 0, Counter(), Counter(), defaultdict(set), defaultdict(set), {}
    bare = {}
    for i, text in rows:
        text = text or ""
        spans = plain_spans(text)
        every = [(m.start(), m.end()) for m in word.finditer(text)]
        total += len(every)
        words = [(a, b) for a, b in every if not any(a < q and p < b for _, p, q in spans)]
        n_t.update(text[a:b].translate(brute.LOWER) for a, b in words)
        bare[i] = words
        near = defaultdict(set)
        for kind, p, q in spans:
            value = text[p:q].translate(brute.LOWER) if kind in ("email", "ip") else re.sub("[^0-9]", "", text[p:q])
            left = [k for k, (a, b) in enumerate(words) if b <= p][-reach:]
            right = [k for k, (a, b) in enumerate(words) if a >= q][:reach]
            near[kind, value] |= {*left, *right}
        of[i] = {e: [text[slice(*words[k])].translate(brute.LOWER) for k in sorted(at)] for e, at in near.items()}
        for e, own in of[i].items():
            c[e] += len(own)
            entity_marks[e].add(tuple(own))
            for t in own:
                both[e, t] += 1
                marks[e, t].add(tuple(own))
    told = {}
    for (e, t), n in both.items():
        if len(marks[e, t]) >= support and len(entity_marks[e]) >= support:
            chance = c[e] / total
            share = math.log2(n / n_t[t] / chance) / -math.log2(chance)
            if share >= least:
                told[e, t] = share
    return {i: [(a, b) for a, b in bare[i] if any((e, (text or "")[a:b].translate(brute.LOWER)) in told and (text or "")[a:b].translate(brute.LOWER) in own for e, own in of[i].items())] for i, text in rows}


def private_rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(150)]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    rows = [(i, text(r.choice([0, 3, 40, 200]))) for i in range(60)]
    for i in range(60, 72):  # Zorba Quine is always beside one address, and Smithers beside a card; both stand in very different texts
        rows.append((i, f"{text(30)} Zorba {text(2)} quine, zorba@example.com {text(40)} Smithers: 4111-1111-1111-1111 {text(i % 3)}"))
    same = f"{text(10)} rareword 1.2.3.4 {text(10)}"
    rows += [(i, same) for i in range(80, 90)]  # copies are one context
    rows += [(100, None), (101, ""), (102, "smithers alone, Zorba too"), (103, "4111 1111 1111 1112 and 256.1.1.1, +1 23"), (104, "é" * 5 + " a@b.cd, +1 (555) 010-2030 " * 3), (105, "w " * 30000 + "zorba@example.com")]
    return rows


def test_terms_that_disclose_match_plain_counting(spark):
    rows = private_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("spans", F.lit("x")).repartition(3)
    got = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    terms = plain_terms(rows)
    assert any(terms.values()) and not terms[102] and not terms[80]
    for i, text in rows:
        base = plain_spans(text or "")
        spans = [f"{k}:{a}:{b}" for k, a, b in base]
        assert got[i]["base_sha256"] == brute.sha(",".join(spans))
        assert got[i]["spans"] == ",".join(spans + [f"term:{a}:{b}" for a, b in terms[i]]), i
        count = Counter(k for k, _, _ in base)
        assert [got[i][f"n_{k}"] for k in (*PATTERNS, "term")] == [*[count[k] for k in PATTERNS], len(terms[i])]
    clean = got[60]["text"]
    assert "zorba" not in clean.lower() and "4111" not in clean and "[EMAIL]" in clean and "[CARD]" in clean and "Smithers" not in clean
    assert got[102]["text"] == "smithers alone, Zorba too"


def test_terms_may_be_none_and_tables_empty(spark):
    docs = spark.createDataFrame([(1, "a@b.c x"), (1, "a@b.c x"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_email"], r["spans"], r["text"]) for r in pii.sanitise(docs).collect())
    assert got == [(0, 0, "", ""), (1, 1, "email:0:5", "[EMAIL] x"), (1, 1, "email:0:5", "[EMAIL] x")]
    assert pii.sanitise(docs.limit(0)).count() == 0


# ---- importance resampling


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=100), min_size=1, max_size=6), st.binary(max_size=300))
def test_crcs_of_words_and_of_strings_put_together(words, tail):
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    got = crc.words(buf, end - np.array([len(w) for w in words]), end)
    assert got.tolist() == [zlib.crc32(w) for w in words]
    put = crc.join(got, np.full(len(got), zlib.crc32(tail), np.uint32), np.full(len(got), len(tail)))
    assert put.tolist() == [zlib.crc32(w + tail) for w in words]


def plain_resample(rows, target, n=2, buckets=10000):
    def features(text):
        words = brute.ALNUM.findall((text or "").translate(brute.LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    raw, aim = Counter(), Counter()
    for _, text in rows:
        raw.update(features(text)[1])
    for text in target:
        aim.update(features(text)[1])
    s, t = sum(raw.values()), sum(aim.values())
    out, long = [], []
    for i, text in rows:
        n_words, own = features(text)
        gains = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None])
        if n_words >= 20:
            long.append(out[-1])
    long.sort(key=lambda x: (-x[3], x[0] is not None, x[0]))
    for rank, row in enumerate(long[: 25 * len(long) // 100]):
        row[4] = rank + 1
    return sorted(map(tuple, out), key=repr)


def test_resampling_matches_plain_counting(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcXYZ1é") for _ in range(r.randint(1, 5))) for _ in range(200)] + ["y" * 90]
    rows = [(i, r.choice([" ", "-", "  \n"]).join(r.choice(words) for _ in range(r.choice([0, 1, 19, 20, 30, 300])))) for i in range(300)]
    rows += [(400, None), (401, " .,; "), (None, " ".join(words[:25])), (402, " ".join(r.choice(words) for _ in range(60000)))]
    target = [" ".join(r.choice(words[:60]) for _ in range(50)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("bucket", "n", "rank", "score", "_range")]).repartition(4)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resample.resample(docs, bench).collect()), key=repr)
    assert got == plain_resample(rows, target)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resample.resample(docs, bench, n=3, buckets=64).collect()), key=repr)
    assert got == plain_resample(rows, target, 3, 64)
    con = duckdb.connect()
    for name, rows_ in (("documents", rows), ("benchmark", list(enumerate(target)))):
        con.execute(f"CREATE TABLE {name} (doc_id BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows_)
    assert sorted(con.execute(resample.ORACLE_SQL).fetchall(), key=repr) == plain_resample(rows, target)
    drawn = {r["doc_id"] for r in resample.draw(docs.filter("doc_id IS NOT NULL"), bench).collect()}
    assert drawn == {x[0] for x in plain_resample([r for r in rows if r[0] is not None], target) if x[4]}


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text)] * 8 + [(2, "short")] * 2, "doc_id long, text string")
    none = docs.limit(0).withColumnRenamed("doc_id", "item_id")
    got = [r["rank"] for r in resample.resample(docs, none).collect()]
    assert sorted(x for x in got if x) == [1, 2] and len(got) == 10
    assert resample.resample(docs.limit(0), none).count() == 0


# ---- conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(ids, damaged):
    """By trying every series of roles of the pattern and every way of getting there, from the last turn backwards."""
    out = []
    for conv in ids:
        rows = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for _, _, role, text in rows:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        best = None
        for m in range(len(rows) + 3):
            for goal in {"", "ua" * (m // 2), "s" + "ua" * (m // 2)} - {"s"}:
                if len(goal) != m:
                    continue
                table = {(len(rows), m): (0, "")}
                for i in range(len(rows), -1, -1):
                    for j in range(m, -1, -1):
                        ways = [table[i, j]] if (i, j) in table else []
                        if i < len(rows) and (i + 1, j) in table:
                            c, a = table[i + 1, j]
                            ways.append((c + 4, "D" + a))
                        if j < m and goal[j] != "s" and (i, j + 1) in table:
                            c, a = table[i, j + 1]
                            ways.append((c + 3, "I" + a))
                        if i < len(rows) and j < m and faults[i] not in ("blank", "duplicate") and (i + 1, j + 1) in table:
                            c, a = table[i + 1, j + 1]
                            c += 3 * (faults[i] == "truncated")
                            if rows[i][2][:1] == goal[j]:
                                ways.append((c, "K" + a))
                            if goal[j] != "s":
                                ways.append((c + 3, "R" + a))
                        if ways:
                            table[i, j] = min(ways)
                if (0, 0) in table:
                    best = min([x for x in (best, (*table[0, 0], goal)) if x])
        cost, audit, goal = best
        lines, i, roles = [], 0, {"u": "user", "a": "assistant"}
        for edit in audit:
            if edit != "D":
                initial = goal[len(lines)]
                lines.append(f"{rows[i][2] if edit == 'K' else roles[initial]}:{'' if edit == 'I' else rows[i][3]}")
            i += edit != "I"
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, brute.sha("\n".join(lines))))
    return sorted(out, key=repr)


def talks(seed=1):
    r = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.choice([1, 2, 4, 7])):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ["user", "assistant"][turn % 2]
            if turn == 0 and r.random() < 0.3 or r.random() < 0.05:
                role = "system"
            if r.random() < 0.05:
                role = r.choice([None, "", "tool", "U"])
            text = r.choice(["Well.", "So! \n", "and\t", "Why?", "", None, " \x0b", f"Number {r.randint(0, 5)}.", "é", "one two"])
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [rows[5], rows[5], rows[9]]
    rows += [(900 + i, 0, "user", "x.") for i in range(40)]  # some of them lose their only row
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def as_rows(df):
    return sorted((tuple(r) for r in df.select(*conversations.NAMES).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_matches_trying_every_pattern(spark, tmp_path, seed):
    rows = talks(seed)
    wanted = plain_repair({r[0] for r in rows}, plain_damage(rows))
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("n", "part", "side", "audit", "fault")]).repartition(3).write.parquet(path)
    assert as_rows(queries()["op13_conversations"](spark, str(tmp_path))) == wanted
    for hold in (0, 200):  # all conversations, or some, the long way
        assert as_rows(conversations.repair(conversations.damaged(spark.read.parquet(path)), hold=hold)) == wanted
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(con.execute(conversations.ORACLE_SQL).fetchall(), key=repr) == wanted


def test_products_are_associative_and_powers_agree():
    r = random.Random(4)
    kinds = [(r.choice("sua"), r.randrange(4)) for _ in range(40)]
    one = conversations.UNIT
    for k in kinds:
        one = conversations.times(one, conversations.turn_matrix(*k))
    assert one == conversations.product(kinds)
    for cut in (1, 7, 39):
        assert one == conversations.times(conversations.product(kinds[:cut]), conversations.product(kinds[cut:]))
    for n in (0, 1, 5, 13):
        again = conversations.UNIT
        for _ in range(n):
            again = conversations.times(again, conversations.turn_matrix("u", conversations.DUPLICATE))
        assert again == conversations.power(conversations.turn_matrix("u", conversations.DUPLICATE), n)


def test_one_conversation_across_partitions_and_a_row_that_stands_often(spark):
    rows = [(7, i, ["user", "assistant"][i % 2], f"Turn {i}." if i % 50 else "Again.") for i in range(3000)] + [(7, 1500, "user", "Often.")] * 2000 + [(8, 0, "user", "Hi.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    plain = conversations.plain(frame)
    got = {r["conv_id"]: r for r in conversations.repair(plain, hold=1000).collect()}
    near = {r["conv_id"]: r for r in conversations.repair(plain.unionByName(spark.createDataFrame([(i, 0, "user", "x.", 1) for i in (-5, 99)], f"{SCHEMA}, n long")).coalesce(1)).collect()}
    assert got[7] == near[7] and got[8] == near[8]
    assert got[7]["duplicate"] == 1999 + 59  # all but the first of each
    assert got[7]["audit"].count("D") >= got[7]["duplicate"] and len(got[7]["repaired_sha256"]) == 64


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damaged(empty)).count() == 0

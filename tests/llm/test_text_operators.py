"""Personal data, line chunks, passages and licences, by brute force."""

from __future__ import annotations

import hashlib
import random
import time
import re

import numpy as np
import pyarrow as pa
import pytest

from runlens.llm import hashing, licenses, line_chunks, pii, queries, suffixes

# the base patterns as they are stated, run without any of the shortcuts
BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def checked(kind, span):
    digits = [int(c) for c in re.sub("[^0-9]", "", span)]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        turned = [d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(turned) % 10 == 0
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def base_spans(text):
    found = [(m.start(), n, m.end()) for n, (kind, pattern) in enumerate(BASE)
             for m in re.finditer(pattern, text) if checked(kind, m.group())]
    return [(BASE[n][0], s, e) for s, n, e in sorted(found)]


def test_base_spans_equal_the_stated_patterns():
    rng = random.Random(8)
    texts = ["".join(rng.choice("a1@.-+ (9)é0_%\n2") for _ in range(rng.randint(0, 70)))
             for _ in range(4000)]
    texts += ["4111 1111 1111 1111 or 4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "999.1.1.1",
              "+1 (555) 010-9999, +49.30.1234567", "a@b.c@d.e x@y", "0" * 400 + ".1.1.1"]
    for text in texts:
        assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS] == base_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "@" * 300_000, "a" * 300_000 + "@", "+1" + " " * 300_000):
        pii.spans_of(text)


def test_validators_and_context():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    # words of the kind raise the score, words of another kind lower it
    assert [s[0] for s in pii.spans_of("Konto DE89 3704 0044 0532 0130 00.")] == ["iban"]
    assert [s[0] for s in pii.spans_of("call tel 030 123 4567")] == ["local_phone"]
    assert pii.spans_of("order 030 123 4567") == []
    assert pii.spans_of("tel 030 123 4567, as order and invoice number") == []
    assert [s[0] for s in pii.spans_of("ssn 123-45-6789 and 000-45-6789")] == ["social_number"]
    assert pii.spans_of("numbers 030 123 4567 alone") == []


def test_pii_rows(spark):
    rows = [(1, "mail é a.b@c.de now", 1), (1, "mail é a.b@c.de now", 2), (2, None, None), (None, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = pii.find_pii(docs).collect()
    assert sorted(((r["doc_id"], len(r["spans"])) for r in got), key=repr) \
        == sorted([(1, 1), (1, 1), (2, 0), (None, 0)], key=repr)
    hit = next(r["spans"][0] for r in got if r["spans"])
    assert (hit["kind"], hit["start"], hit["end"], hit["value"]) == ("email", 7, 15, "a.b@c.de")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect() if r["text"]}
    assert clean == {1: "mail é <email> now"}
    assert pii.find_pii(docs.where("false")).collect() == []


def test_pii_query_against_the_patterns(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in
             spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op8(spark, folder).collect():
        want = base_spans(texts[r["doc_id"]])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in BASE] == [sum(w[0] == k for w in want) for k, _ in BASE]


# --- line chunks -----------------------------------------------------------

def line_bounds(text, **how):
    for _, _, data, rows in hashing.slabs(pa.array([text])):
        hashes, _, _, first = hashing.lines(data, rows)
        return line_chunks.chunk_bounds(hashes, first, **how).tolist()


def chunks_of(lines, bounds):
    """(first line, line after the last, blank lines above, below) of the chunks of a text."""
    full = [i for i, x in enumerate(lines) if x]
    for n, (a, b) in enumerate(zip(full[:-1], full[1:])):
        if bounds[a] or bounds[b]:
            above = a - (full[n - 1] + 1 if n else 0)
            below = (full[n + 2] if n + 2 < len(full) else len(lines)) - b - 1
            yield a, b + 1, above, below


def cut_lines(rows, **how):
    """(doc_id, text) -> text without chunks that stand earlier, in order of doc_id."""
    first, out = {}, {}
    for n, (i, text) in enumerate(sorted(set(r for r in rows if r[0] is not None and r[1]))):
        lines, cut = text.split("\n"), set()
        for a, b, above, below in chunks_of(lines, line_bounds(text, **how)):
            m, end, up, down = first.setdefault(tuple(lines[a:b]), (n, b, above, below))
            if (m, end) <= (n, a):
                cut |= set(range(a - min(up, above), b + min(down, below)))
        out[i, text] = "\n".join(x for k, x in enumerate(lines) if k not in cut)
    return out


def test_line_chunks_equal_brute_force(spark):
    rng = random.Random(3)
    block = [f"shared line {i}" for i in range(30)]
    rows = []
    for i in range(60):
        lines = [rng.choice(["", "x", f"own {rng.random()}"]) for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = block[rng.randint(0, 5):]
        rows.append((i, "\n".join(lines)))
    rows += [(70, rows[0][1]), (71, "one line"), (72, "\n\n\n\n\n\n"), (73, "l\n" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(docs).collect()}
    want = cut_lines(rows)
    assert got == {i: want.get((i, t), "") for i, t in rows}
    assert sum(len(t) for t in got.values()) < 0.8 * sum(len(t) for _, t in rows)
    wide = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(docs, 2, (1, 3)).collect()}
    assert wide == {i: cut_lines(rows, window=2, share=(1, 3)).get((i, t), "") for i, t in rows} != got


def test_lines_of_a_slab_equal_split():
    texts = ["a\nb", "\nx", "", "\n", "", "\n\ny\n", None, "z"]
    for _, _, data, rows in hashing.slabs(pa.array(texts)):
        _, starts, ends, first = hashing.lines(data, rows)
        got = [[bytes(data[a:b]).decode() for a, b in zip(starts[first[i]:first[i + 1]],
                                                          ends[first[i]:first[i + 1]])]
               for i in range(len(texts))]
    assert got == [(t or "").split("\n") for t in texts]


def test_bounds_do_not_shift():
    lines = [f"line {i}" for i in range(200)]
    for how in ({}, {"window": 3, "share": (1, 4)}):
        whole, later = line_bounds("\n".join(lines), **how), line_bounds("\n".join(["new"] * 7 + lines), **how)
        assert whole[2:] == later[9:] and 0 < sum(whole) < 200


def test_long_runs_of_blank_lines(spark):
    rows = [(i, f"a\nb{chr(10) * 20_000}c\nd{chr(10) * 5_000}{i}\nz") for i in range(3)]
    rows.append((9, "\n" * 50_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (r["text"], r["n_lines_cut"]) for r in line_chunks.dedup_runs(docs).collect()}
    assert time.time() - began < 30
    assert got[0] == (rows[0][1], 0) and got[9] == (rows[3][1], 0)
    assert got[2][0].split("\n") == ["2", "z"] and got[2][1] == 4 + 19_999 + 4_999


def test_line_chunks_nulls_repeats_and_columns(spark):
    text = "\n".join(f"a line {i}" for i in range(40))
    rows = [(2, text, "a"), (2, text, "b"), (1, text, "c"), (None, text, "d"), (3, None, "e"), (4, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string")
    got = line_chunks.dedup_lines(docs).collect()
    by = {r["version"]: r["text"] for r in got}
    assert got[0].asDict().keys() == {"doc_id", "text", "version", "n_lines_cut"}
    assert by["c"] == by["d"] == text and by["e"] is None and by["f"] == ""
    assert by["a"] == by["b"] and len(by["a"]) < len(text) / 4
    assert line_chunks.dedup_lines(docs.where("false")).collect() == []


def without_runs(rows):
    """(doc_id, text) -> text without any line of a run that stands earlier, by brute force."""
    seen, out = {}, {}
    order = sorted(rows)
    for n, (i, text) in enumerate(order):
        lines = text.split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(map(bool, lines[a:b])) >= 2:
                    seen.setdefault(tuple(lines[a:b]), (n, b))
    for n, (i, text) in enumerate(order):
        lines, cut = text.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(map(bool, lines[a:b])) >= 2 and seen[tuple(lines[a:b])] <= (n, a):
                    cut |= set(range(a, b))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in cut), len(cut)
    return out


def test_line_runs_equal_brute_force_over_all_runs(spark):
    rng = random.Random(11)
    block = [rng.choice(["", f"shared {i}", f"shared {i}"]) for i in range(30)]
    rows = []
    for i in range(80):
        lines = [rng.choice(["", "x", f"own {rng.random()}", f"own {rng.random()}"])
                 for _ in range(rng.randint(0, 12))]
        for _ in range(i % 3):
            at, begin = rng.randint(0, len(lines)), rng.randint(0, 25)
            lines[at:at] = block[begin:begin + rng.randint(2, 8)]
        rows.append((i, "\n".join(lines)))
    rows += [(90, rows[2][1]), (91, "one line"), (92, "\n\n\n\n"), (93, "l\n" * 30),
             (94, "own a\nmid one\nmid two\nown b"), (95, "c\nd\ne\nmid one\nmid two\nf\ng")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines_cut"])
           for r in line_chunks.dedup_runs(docs).collect()}

    def content(text):
        return [x for x in text.split("\n") if x]
    # of the blank lines around a chunk only those go that its first occurrence has
    want = without_runs(rows)
    assert {i: content(t) for i, (t, _) in got.items()} == {i: content(t) for i, (t, _) in want.items()}
    assert got[95][0] == "c\nd\ne\nf\ng" and got[93][0] == "l\nl\n" and got[92][1] == 0


def test_bounds_find_most_of_all_repeated_lines(spark):
    rng = random.Random(4)
    block = [f"shared line {i} {rng.random()}" for i in range(600)]
    rows = []
    for i in range(300):
        lines = [f"own {rng.random()}" for _ in range(6)]
        for _ in range(3):
            at, begin = rng.randint(0, len(lines)), rng.randint(0, 590)
            lines[at:at] = block[begin:begin + rng.randint(2, 8)]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_chunks.dedup_lines(docs).agg({"n_lines_cut": "sum"}).first()[0]
    assert found >= 0.9 * line_chunks.dedup_runs(docs).agg({"n_lines_cut": "sum"}).first()[0] > 1000


def test_the_query_cuts_repeated_chunks(spark, tmp_path):
    rows = [(1, "a\nmid one\nmid two\nmid three\nb"), (2, "c\nd\ne\nmid one\nmid two\nmid three\nf")]
    assert any(line_bounds(rows[0][1])[1:4])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: cut_lines(rows)[i, t] for i, t in rows} and got[2] != rows[1][1]


# --- passages --------------------------------------------------------------

def covered(rows, least):
    """doc_id -> word numbers that lie in a run of words found in another document."""
    where, words = {}, {}
    for i, text in rows:
        words[i] = (text or "").lower().split()
        for p in range(len(words[i]) - least + 1):
            where.setdefault(tuple(words[i][p:p + least]), set()).add(i)
    out = {}
    for i, w in words.items():
        marks = {p + k for p in range(len(w) - least + 1)
                 if len(where[tuple(w[p:p + least])]) > 1 for k in range(least)}
        if marks:
            out[i] = marks
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(3000)}"
    shared = [[word() for _ in range(n)] for n in (49, 51, 60, 200)]
    rows = []
    for i in range(80):
        words = [word() for _ in range(rng.randint(0, 300))]
        if i % 2:
            part = shared[i % 4 if i % 8 else 3]
            at = rng.randint(0, len(words))
            words[at:at] = part
        rows.append((i, " ".join(words)))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "same " * 300), (104, "same " * 200),
             (105, "Own words " * 100)]
    return rows


def test_passages_equal_brute_force(spark, passages):
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    found = suffixes.repeated_passages(docs).collect()
    got = {}
    for r in found:
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50
        assert r["other_doc_id"] != r["doc_id"]
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert got == covered(passages, 50)


def test_passages_across_partitions_and_without_rows(spark, passages):
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = suffixes.repeated_passages(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    marks = {}
    for r in got:
        marks.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert marks == covered(passages, 50)
    assert suffixes.repeated_passages(docs.where("false")).collect() == []


def test_passages_are_cut_but_for_their_first_document(spark, passages):
    schema = "doc_id long, text string, start_word string"
    rows = [(i, t, "x") for i, t in passages] + [(None, passages[3][1], None), (3, passages[3][1], "y")]
    docs = spark.createDataFrame(rows, schema)
    found = suffixes.repeated_passages(docs)
    got = suffixes.without_passages(docs, found).collect()
    assert len(got) == len(rows) and docs.columns == list(got[0].asDict())
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[100] == "" and text[None] == passages[3][1] and text[105] == passages[-1][1]


def test_a_passage_whose_parts_are_frequent_is_found(spark):
    rng = random.Random(5)

    def own(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    def low(words):
        for _, _, data, rows in hashing.slabs(pa.array([" ".join(words)])):
            return int(hashing.fold(hashing.words(data, rows)[0], 8)[0])

    # the gram in the middle has a small hash, so it is the minimiser
    middle = min((own(8) for _ in range(3000)), key=low)
    left, right = own(21), own(21)
    texts = [own(40) + left + middle + right + own(40) for _ in range(2)]
    texts += [own(61) + middle + right + own(40) for _ in range(300)]
    texts += [own(40) + left + middle + own(61) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["other_doc_id"])
                 for r in suffixes.repeated_passages(docs).collect())
    assert got == [(0, 40, 90, 1), (1, 40, 90, 0)]


# --- licences --------------------------------------------------------------

def test_every_known_sentence_is_normal_and_tells():
    for name, sentence in licenses.SENTENCES.items():
        assert re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", sentence)
        assert any(w in sentence for w in licenses.TELL_TALES)
    assert {s for _, _, rule in licenses.RULES for s in rule} <= set(licenses.SENTENCES)


def test_rules_need_their_sentences_in_order(spark):
    said = licenses.SENTENCES
    bsd = [said[s].capitalize() + "." for s in ("bsd-use", "bsd-source", "bsd-binary", "bsd-names")]
    wrapped = "\n".join(" * " + line for line in re.findall(r".{1,60}(?:\s|$)", " ".join(bsd)))
    rows = [
        (0, "\n".join(bsd), ["BSD-3-Clause"]), (1, "\n".join(bsd[:3]), ["BSD-2-Clause"]),
        (2, "\n".join(bsd[::-1]), []), (3, "Some text.\n" + " Other words. ".join(bsd), ["BSD-3-Clause"]),
        (4, wrapped, ["BSD-3-Clause"]), (5, None, []), (6, "", []), (7, "no licence at all", []),
        (8, "No end mark\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.",
         ["CC-BY-NC-4.0", "MIT"]),
        (None, "LICENSED   under the Apache License,\nVersion 2.0.", ["Apache-2.0"]),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows],
                                 "doc_id long, text string, licences string")
    got = {r["doc_id"]: [x["licence"] for x in r["licences"]] for r in licenses.scan(docs).collect()}
    assert got == {i: want for i, _, want in rows}
    assert licenses.scan(docs.where("false")).collect() == []
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_minimisers_are_shared_by_equal_windows():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    first = np.array([0, 150, 400])
    row, at, _, low, high = suffixes.minimisers(words, first)
    # each window of a text is stood for once, by a gram inside it
    windows = sorted((r, s) for r, a, b in zip(row, low, high) for s in range(a, b + 1))
    assert windows == [(r, s) for r in (0, 1) for s in range(first[r], first[r + 1] - 49)]
    assert all(a <= p <= a + 42 and b <= p for p, a, b in zip(at, low, high))

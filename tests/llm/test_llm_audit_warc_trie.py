"""Filter audit, web archives and conversation tries against SQL and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

import oracle
from stacktally.llm import filter_audit, prefix_trie, queries, warc


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_warc", "op13_prefix_trie"])
def test_queries_match_sql(spark, sf_dir, name):
    result = queries.queries()[name](spark, sf_dir)
    assert oracle.compare(result, oracle.connect(sf_dir), queries.oracle_sql()[name]) > 0


# --- filter audit ------------------------------------------------------------------

def test_weights_are_the_shapley_values():
    worth = [hash(f"w{s}") % 1000 if s else 0 for s in range(32)]
    for i, row in enumerate(filter_audit.shapley_weights(5)):
        gains = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            gains += worth[before | 1 << i] - worth[before]
        assert sum(a * b for a, b in zip(row, worth)) == Fraction(gains, 120)


def _audited(docs, labels):
    """The audit by applying the filters, order by order."""
    ids = defaultdict(list)
    for doc_id, text, _ in docs:
        ids[text or ""].append(doc_id)
    fails = {}
    for n, (doc_id, text, _) in enumerate(docs):
        text = text or ""
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        smaller = doc_id is not None and any(i is not None and i < doc_id for i in ids[text])
        fails[n] = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": smaller,
        }
    rows = {}
    for part in {lang or "" for _, _, lang in docs}:
        mine = [n for n, d in enumerate(docs) if (d[2] or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [n for n in left if fails[n][f]]
                left = [n for n in left if not fails[n][f]]
                total[f] += len(gone)
                lost = lambda what: sum(docs[n][0] is not None and (docs[n][0], what) in labels for n in gone)  # noqa: B023, E731
                rows[part, "".join(order), step] = [
                    len(left), len(gone), sum(fails[n][f] for n in mine) - len(gone),
                    sum([k for k in "ABCDE" if fails[n][k]] == [f] for n in mine), lost("good"), lost("toxic"),
                ]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in rows.items()}


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, None), (3, None, "en"), (4, "", "fr"), (5, "A $ B", "fr"),
        (None, long, "en"), (None, None, ""), (6, "a " * 300, "en"), (7, "X" * 10 + long, "fr"), (8, " \t\n\x0b\x0c\r", "en"),
        (9, "\x85  ", "fr"), (1, long, "en"), (10, "È" * 5 + " é", "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (None, 1, 1), (5, None, 1), (99, 1, 1)]
    marks = {(i, "good") for i, g, _ in labels if g and i is not None} | {(i, "toxic") for i, _, t in labels if t and i is not None}
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    table = table.withColumns({c: F.lit("x") for c in ("part", "bits", "key", "n", "first", "mask", "good")})
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit(1))
    rows = filter_audit.audit(table, marked).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rows} == _audited(docs, marks) and len(rows) == 600 * 3
    assert filter_audit.audit(table.limit(0), marked).count() == 0
    assert filter_audit.audit(table, marked.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


# --- web archives --------------------------------------------------------------------

def test_archive_round_trip(spark, tmp_path):
    big = "é" * 700 + "\r\n\r\nWARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:0>\r\n" + "<p>x</p>\n" * 300
    pages = [
        (1, "http://a/", big), (2, "http://a/b c", big), (3, None, "small"), (4, "http://é/\r\nX: 1", "small"), (5, "u", None),
        (6, "u", ""), (7, "u", "y" * 1000), (8, "u", "y" * 1000), (8, "u", "y" * 1000), (9, "u", "z" * 999), (10, "u", "z" * 999),
        (None, "u", big), (None, "n", "q" * 3000), (None, "n", "q" * 3000), (-4, "n", "\r\n" * 600), (11, "n", "\r\n\r\n"),
        (12, "n", "\x00\x0b" * 900),
    ]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    table = table.withColumns({c: F.lit(1) for c in ("payload", "digest", "row", "segment", "last", "block")})
    for segment in (7, 256, 1 << 16):
        path = str(tmp_path / f"s{segment}")
        warc.write(table.repartition(3), path, segment_bytes=segment)
        rows = warc.read(spark, path).collect()
        last = {}
        for page_id, _, html in pages:
            if page_id is not None:
                last[html] = max(last.get(html, page_id), page_id)
        want = Counter()
        for page_id, _, html in pages:
            data = (html or "").encode()
            other = last.get(html) if len(data) >= 1000 else None
            again = other is not None and (page_id is None or page_id < other)
            want[page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", other if again else None] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
        assert all(r.intact for r in rows)
        chunks = warc.read_chunks(spark, path).filter("record_type <> 'revisit'")
        assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= segment
    assert {r.url for r in rows} == {None, "http://a/", "http%3A%2F%2Fa%2Fb+c", "http%3A%2F%2F%C3%A9%2F%0D%0AX%3A+1", "u", "n"}


def test_damage_is_noticed(spark, tmp_path):
    pages = [(i, "u", f"{i} " * 400) for i in range(4)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    warc.write(table, str(tmp_path / "a"), segment_bytes=100, compression="none")
    (file,) = (tmp_path / "a/records").glob("part-*")
    text = file.read_bytes()
    (tmp_path / "a/records" / f".{file.name}.crc").unlink()
    file.write_bytes(text.replace(b"2 2 2 2", b"2 2 5 2", 1))
    assert {r.page_id: r.intact for r in warc.read(spark, str(tmp_path / "a")).collect()} == {0: True, 1: True, 2: False, 3: True}


def test_an_empty_archive(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write(empty, str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


# --- tries of conversations -------------------------------------------------------------

def _trie(rows):
    """Every rebuilt conversation as a list, every beginning as a tuple."""
    stored = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            stored[conv].append(((turn is not None, turn or 0, key), (role, text)))
    turns = {c: [t for _, t in sorted(ts)] for c, ts in stored.items()}
    rebuilt = {}
    for c in turns:
        head = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:head] + turns[c][head:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    out = Counter()
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in convs if rebuilt[c] == node)))
        out[
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node],
            sum(not children[m] for m in below),
            sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
            hashlib.sha256(ends.encode()).hexdigest(),
        ] += 1
    return out


CONTRACT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_odd_rows(spark):
    rows = [(c, t, "user", f"t{(c * t) % 3}") for c in range(-12, 23) for t in range(1 + abs(c) % 12)]
    rows += [(100, None, "user", "first"), (100, 1, None, None), (100, 1, "user", "tie"), (100, 1, "user", "tie"), (101, 5, "a", "é")]
    rows += [(None, 1, "user", "nobody"), (104, 1, "user", ""), (104, 1, "user", ""), (9_000_000_004, 0, "x", "far")]
    # one conversation that holds most rows, and its copy
    rows += [(c, t, "user", f"long {t % 7}") for c in (30, 40) for t in range(120)]
    # conversations that are alike and far apart in number end at one node
    rows += [(c, t, "user", "same") for c in range(50_000, 90_000, 1_000) for t in range(12)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    table = table.withColumns({c: F.lit("x") for c in ("key", "pos", "n_bytes", "head", "base", "depth", "s0", "rank", "_piece")})
    found = prefix_trie.trie(table)
    assert Counter(tuple(r) for r in found.select(CONTRACT).collect()) == _trie(rows)
    assert prefix_trie.trie(table.limit(0)).count() == 0


def test_colliding_elements_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PRIMES", (5, 7, 11))
    rows = [(c, t, "user", f"{c} {t}") for c in range(60) for t in range(10)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    with pytest.raises(RuntimeError):
        prefix_trie.trie(table, range(2))

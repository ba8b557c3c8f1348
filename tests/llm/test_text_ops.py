"""Token counts, byte BPE, URL filter, mixture, WARC: against the libraries and brute force, with edge cases."""

import hashlib
import random
from collections import Counter
from math import log

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trafficlens.llm import byte_bpe, mixing, queries, token_count, url_filter, warc_fixity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "a", "İstanbul ẞ ﬁ e\u0301 \u1100\u1161", "<|endoftext|> x<|startoftext|>y", "\u00a0\u2003\x85\x1c\n\n\r\t  z", "don't we'll 123 ²½Ⅷ _-_", "🙂👩‍👩‍👧 漢字かな", "a" * 5000, "é" * 3000, "x1" * 2000, " " * 3000, "\0\ufffd"]


def prose(seed, words):
    r = random.Random(seed)
    make = lambda: "".join(r.choice(["th", "er", "on", "é", "an", "I", "9", "'s", "."]) for _ in range(r.randint(1, 6)))
    return " ".join(make() for _ in range(words))


# ---- token counts ----------------------------------------------------------------------------------------------


def library_count(text):
    return len(Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark):
    texts = ODD + [prose(i, 30 * i) for i in range(20)] + [prose(99, 4000), prose(98, 900) + "q" * 4000 + prose(97, 900)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for chunk, overlap in ((1 << 16, 1 << 10), (600, 60), (2000, 20)):
        got = {r["doc_id"]: r for r in token_count.count_tokens(df, WORD_BPE, chunk=chunk, overlap=overlap).collect()}
        for i, t in enumerate(texts):
            assert got[i]["n_tokens"] == library_count(t), (i, chunk)
            assert got[i]["n_bytes"] == len((t or "").encode())
            assert got[i]["over_limit"] == (got[i]["n_tokens"] > 2048)
    assert token_count.count_tokens(df.limit(0), WORD_BPE).count() == 0


def test_chunks_are_spliced_and_widened():
    counter = token_count.Counter(WORD_BPE, chunk=500, overlap=40)
    for text in (prose(1, 3000), "a" * 3000, "b " * 2000, prose(2, 100) + " " * 2000 + prose(3, 100), "<|endoftext|>" * 300):
        assert counter.one(text) == library_count(text)


def test_short_texts_are_counted_by_words_and_words_encoded_once(monkeypatch):
    """Every white space and odd character at the seams of words, with a table that overflows; no word goes to the library twice."""
    odd = [t for t in ODD if t] + [a + s + b for s in (" ", "\t", "\n", "\x0b", "\f", "\r", "\x1c", "\x85", "\u00a0", "\u2028") for a in ("a", "e", "'", "<|endoftext|>", "Σ", "\u1100") for b in ("\u0301", "s", "'s", "\u1161", "t", "<|endoftext|>")]
    counter, whole = token_count.Counter(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for known in (150_000, 7):
        monkeypatch.setattr(token_count, "KNOWN_WORDS", known)
        for text in (*odd, prose(5, 800)):
            assert counter.one(text) == len(whole.encode(text, add_special_tokens=False).ids), text
    counter, asked = token_count.Counter(WORD_BPE), []
    monkeypatch.setattr(token_count, "KNOWN_WORDS", 150_000)
    encode = counter.words.encode
    monkeypatch.setattr(counter.words, "encode", lambda words, **kw: asked.extend(words) or encode(words, **kw))
    assert counter.one("one two two\tone " * 500) == 2000 and sorted(asked) == ["one", "two"]


# ---- byte BPE --------------------------------------------------------------------------------------------------


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("form", [byte_bpe.digests, byte_bpe.digests_by_fold_column])
def test_ids_equal_the_library(spark, form, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN_WORDS", 50)
    texts = ODD + [prose(i, 40 * i) for i in range(12)]
    texts = [t for t in texts if form is byte_bpe.digests or t is None or len(t) < 2000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in form(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library().encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert form(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_both_folds_agree():
    ranks = byte_bpe.load_ranks(RANKS)
    r = random.Random(4)
    for _ in range(500):
        word = bytes(r.choice(b"aehnort \xc3\xa9'1") for _ in range(r.randint(1, 40)))
        assert byte_bpe._fold_long(word, ranks) == byte_bpe.fold(word, ranks) or word in ranks


def test_bounded_memory_of_words():
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    assert encoder.ids(None) == b"" and encoder.ids("") == b""
    for i in range(10):
        encoder.ids(prose(i, 50))
    assert len(encoder) <= byte_bpe.KNOWN_WORDS


# ---- URL filter ------------------------------------------------------------------------------------------------


def slow_split(label, cost, unknown):
    def best(i):
        if i == len(label):
            return 0.0
        return min(cost.get(label[i:j], unknown + log(10) * (j - i)) + best(j) for j in range(i + 1, len(label) + 1))

    return best(0)


def test_viterbi_finds_the_cheapest_split():
    seg = url_filter.Segmenter({"th": 9, "er": 5, "the": 3, "ring": 2, "her": 1})
    for label in ("thering", "thther", "ringer", "xth", "t", "herherth"):
        words = seg.split(label)
        assert "".join(words) == label
        assert abs(sum(seg.cost.get(w, seg.unknown + log(10) * len(w)) for w in words) - slow_split(label, seg.cost, seg.unknown)) < 1e-9


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG", "http://a.example.org/", "https://example.org/es/1?x=/de/", "http://example.org/en/15#t", "http://example.org/en/2",
    "http://notexample.org/en/1", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/de", "http://x.com/en/7", "http://com/fr/", "https://u.net/de/3?a://b/c", "a://b://c/d",
    "http://y.net:80/p#q", "x\ny://multi.org/line\nbreak", "http://ÄB.net/Ü",
]


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    end = next((i for i, c in enumerate(rest) if i >= cut and c in "?#"), len(rest))
    return host, rest[cut:end]


def test_urls_and_rules(spark):
    rules = [url_filter.parse_rule(x) for x in queries.RULES]
    rows = [(i, u, "<p>the ring her there</p>" * 3, "x") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, rules).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        host, path = slow_parts(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        assert got[i]["rule"] == (rule.name if rule else None), u
        assert got[i]["verdict"] == (rule.verdict if rule else got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_bayes_equals_counting(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rules = [url_filter.parse_rule(x) for x in queries.RULES]
    rows = url_filter.filter_urls(pages, rules).collect()
    counts = Counter(w for r in pages.collect() for w in __import__("regex").findall(r"\p{L}+", __import__("re").sub(r"<[^<>]*>", " ", r["html"]).lower()) if len(w) <= url_filter.LONGEST_WORD)
    assert len(counts) <= url_filter.UNIGRAMS
    seg = url_filter.Segmenter(dict(counts))
    seen, n = {"allow": Counter(), "block": Counter()}, Counter()
    for r in rows:
        if r["rule"]:
            n[r["verdict"]] += 1
            seen[r["verdict"]].update(seg.tokens(r["host"], r["path"]))
    known = set(seen["allow"] + seen["block"])
    total = {v: sum(c for t, c in seen[v].items() if t in known) + len(known) + 1 for v in seen}
    for r in rows:
        if not r["rule"]:
            odds = log((n["block"] + 1) / (n["allow"] + 1))
            for t in seg.tokens(r["host"], r["path"]):
                odds += log(((seen["block"][t] if t in known else 0) + 1) / total["block"]) - log(((seen["allow"][t] if t in known else 0) + 1) / total["allow"])
            assert abs(odds - r["score"]) < 1e-6 and r["verdict"] == ("block" if odds > 0 else "allow")


# ---- mixture ---------------------------------------------------------------------------------------------------


def slow_budgets(caps, weights, total):
    """Top-down sharing by repeated capping: caps by (domain, lang, source)."""

    def share(prefix, budget, out):
        if prefix in caps:
            out[prefix] = budget
            return
        kids = sorted({k[: len(prefix) + 1] for k in caps if k[: len(prefix)] == prefix})
        cap = {k: sum(c for p, c in caps.items() if p[: len(k)] == k) for k in kids}
        w = {k: weights.get(k, 1) for k in kids}
        full = set()
        while True:
            left = budget - sum(cap[k] for k in full)
            free = [k for k in kids if k not in full]
            part = {k: left * w[k] / sum(w[x] for x in free) for k in free}
            more = {k for k in free if cap[k] <= part[k] + 1e-9}
            if not more or not free:
                break
            full |= more
        for k in kids:
            share(k, cap[k] if k in full else part[k], out)

    out = {}
    share((), total, out)
    return out


def test_mixture_meets_the_budgets(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["w", "f", None]), r.choice(["en", "de"]), r.choice("abc"), r.choice([0, 1, 3, 10, 50])) for i in range(400)]
    rows += [(i, "hot", "en", "a", 20) for i in range(400, 700)]
    df = spark.createDataFrame(rows, "doc_id long, d string, l string, s string, t int")
    levels = {"domain": F.col("d"), "lang": F.col("l"), "source": F.col("s")}
    weights = {("hot",): 1, ("w",): 6, ("w", "en"): 5, ("w", "en", "b"): 4}
    for share, epochs in ((0.3, 4), (1.0, 2), (1.7, 2), (5.0, 2)):
        got = mixing.mix(df, levels, weights, F.col("t"), F.col("__all") * F.lit(share), epochs).collect()
        assert len(got) == len(rows)
        caps, all_ = Counter(), sum(x[4] for x in rows)
        for _, d, lang, s, t in rows:
            caps[d or "(null)", lang, s] += t * epochs
        want = slow_budgets(dict(caps), weights, min(int(all_ * share), sum(caps.values())))
        by = {}
        for g in got:
            by.setdefault((g["domain"], g["lang"], g["source"]), []).append(g)
        for leaf, docs in by.items():
            budget = docs[0]["leaf_budget"]
            assert abs(budget - want[leaf]) <= 1.0, leaf
            taken = sum(g["n_tokens"] * g["copies"] for g in docs)
            assert taken <= budget and budget - taken <= max(g["n_tokens"] for g in docs)
            assert all(g["copies"] <= epochs for g in docs) and all(g["copies"] == 0 for g in docs if not g["n_tokens"])
    assert mixing.mix(df.limit(0), levels, weights, F.col("t")).count() == 0


# ---- WARC ------------------------------------------------------------------------------------------------------


def test_audit_finds_exactly_the_damage(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "RANGE", 256)
    monkeypatch.setattr(warc_fixity, "FAN_OUT", 4)
    r = random.Random(6)
    rows, at = [], Counter()
    for i in range(600):
        f, n = f"f{i % 3}", r.randint(20, 300)
        rows.append([f, at[f], n, hashlib.sha256(str(i).encode()).hexdigest()])
        at[f] += n
    other = [list(x) for x in rows]
    damage = {}
    for i in r.sample(range(600), 25):
        damage[rows[i][0], rows[i][1]] = "corrupt"
        other[i][3] = "0" * 64
    gone = r.sample([i for i in range(600) if (rows[i][0], rows[i][1]) not in damage], 5)
    damage |= {(rows[i][0], rows[i][1]): "missing" for i in gone}
    other = [x for i, x in enumerate(other) if i not in gone] + [["f9", 0, 5, "1" * 64]]
    damage["f9", 0] = "extra"
    schema = "warc_file string, warc_offset long, warc_length long, digest string"
    a, b = (spark.createDataFrame(x, schema) for x in (rows, other))
    assert {(x["warc_file"], x["warc_offset"]): x["status"] for x in warc_fixity.audit(a, b).collect()} == damage
    assert warc_fixity.audit(a, a).count() == 0 and warc_fixity.audit(a.limit(0), a.limit(0)).count() == 0
    assert warc_fixity.audit(a.limit(0), b).count() == len(other)


def test_reading_warc_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, None, None), (3, "http://c/", "x\r\n\r\nWARC/1.0\r\n")], "page_id long, url string, html string")
    made = [r[0].encode() for r in rows.select(warc_fixity.warc_record(F.col("url"), F.col("page_id"), F.col("html"))).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    (tmp_path / "b.warc").write_bytes(made[0] + b"garbage" + made[1][:30])
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc_fixity.read_warc(spark, str(tmp_path)).collect()
    a = sorted((r["warc_offset"], bytes(r["record"])) for r in got if r["warc_file"].endswith("a.warc"))
    assert [x for _, x in a] == made
    b = sorted((r["warc_offset"], bytes(r["record"])) for r in got if r["warc_file"].endswith("b.warc"))
    assert b"".join(x for _, x in b) == made[0] + b"garbage" + made[1][:30]
    assert not [r for r in got if r["warc_file"].endswith("c.warc")]


def test_decode_by_itself(spark):
    df = spark.createDataFrame([(1, [0, 50255, 262]), (2, []), (3, None)], "doc_id long, ids array<int>")
    ranks = {v: k for k, v in byte_bpe.load_ranks(RANKS).items()}
    got = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(df, RANKS).collect()}
    assert bytes(got[1]) == ranks[0] + ranks[50255] + ranks[262] and bytes(got[2]) == b"" and got[3] is None

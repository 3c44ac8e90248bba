"""The registered queries themselves: names, types, digests and awkward rows, on a small table written as Parquet."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from vulnlake.llm import langid, queries
from vulnlake.llm.common import tokenizer_path

from test_corpus_operators import brute_base, brute_components, brute_dedup, brute_fingerprint, brute_licences, brute_losses, brute_spans

DRAW = random.Random(21)
LETTERS = {"aa": "abcdeé", "bb": "mnopqß"}


def prose(lang, n):
    return " ".join("".join(DRAW.choice(LETTERS[lang]) for _ in range(DRAW.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage, short = prose("aa", 120), prose("bb", 55)
    texts = [("aa" if i % 2 else "bb", prose("aa" if i % 2 else "bb", DRAW.randint(5, 160))) for i in range(40)]
    texts += [("aa", f"{prose('aa', 30)} {p} {prose('aa', 20)}") for p in (passage, passage, short, short)]
    texts += [texts[3], texts[3], ("aa", None), (None, None), ("bb", ""), ("bb", "\n \t"), (None, "1 2 3"), ("aa", "x" * 300_000), ("bb", "word\n" * 3000)]
    texts += [("aa", "MIT License and apache license.\nSPDX-License-Identifier: Zlib\n" + prose("aa", 60))]
    found = [(i, t, lang, "s", None if t is None else len(t), "clash", 7) for i, (lang, t) in enumerate(texts)]
    return [*found, found[3]]


@pytest.fixture(scope="module")
def place(spark, rows, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, `n.tokens` long").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 45)] + [(2, 1, 0)], "doc_id long, quality int, toxic int")
    for name, part in (("full", frame), ("none", frame.filter("false"))):
        part.write.parquet(f"{where}/{name}/documents.parquet")
        turns = spark.createDataFrame([(c, t, "user", f"turn {t * (c % 3)}", "clash") for c in range(8) for t in range(c)], "conv_id long, turn long, role string, text string, depth string")
        turns.filter("true" if name == "full" else "false").write.parquet(f"{where}/{name}/conversations.parquet")
        labels.filter("true" if name == "full" else "false").write.parquet(f"{where}/{name}/labels.parquet")
    return str(where)


COLUMNS = {
    "op1_mpeg_ts": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op2_bpe_trie": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_lm_difference": "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double",
    "op7_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op8_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_best_fit": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint",
    "op11_hypergeometric_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op12_spelling_variants": "word string, n bigint, n_near bigint, form string, form_n bigint, root string",
    "op13_conversation_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


@pytest.fixture(scope="module")
def results(spark, place):
    return {name: f(spark, f"{place}/full").collect() for name, f in queries.queries().items()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def values(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def want(rows, f):
    return sorted(((r[0], *f(r[1] or "")) for r in rows), key=str)


def test_schemas_and_empty_tables(spark, place):
    assert set(queries.queries()) == set(COLUMNS)
    for name, f in queries.queries().items():
        out = f(spark, f"{place}/none")
        got = [f"{n} {t}" for n, t in out.dtypes]
        wanted = COLUMNS[name].split(", ")
        assert got[: len(wanted)] == wanted and out.count() == 0, name


def test_streams(rows, results):
    def one(t):
        b = t.encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        return len(b), len(p), sha(p), zlib.crc32(p[-64:])

    got = results["op1_mpeg_ts"]
    assert values(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want(rows, one)
    assert all(r.media_bytes >= r.payload_bytes and len(r.media_sha256) == 64 and r.feature for r in got)
    assert len({r.media_sha256 for r in got}) == len({r[1] or "" for r in rows})


def test_tokens(rows, results):
    words, bytes_ = (Tokenizer.from_file(tokenizer_path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))

    def coded(t):
        ids = words.encode(t, add_special_tokens=False).ids
        return len(ids), sha(" ".join(map(str, ids))), sha(words.decode(ids, skip_special_tokens=False))

    assert values(results["op2_bpe_trie"], "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(rows, coded)
    ids = {r[0]: bytes_.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    counted = sorted(((r[0], len((r[1] or "").encode()), len(ids[r[0]]), len(ids[r[0]]) > 1024) for r in rows), key=str)
    assert values(results["op8_token_counts"], "doc_id", "n_bytes", "n_tokens", "over_limit") == counted
    filled = defaultdict(list)
    for r in results["op9_best_fit"]:
        part = [*ids[r.doc_id], 2][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert Counter(r.doc_id for r in results["op9_best_fit"]) == Counter(r[0] for r in rows for _ in range(-(-(len(ids[r[0]]) + 1) // 1024)))
    for spans in filled.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(filled) <= 1 + -(-sum(r.length for r in results["op9_best_fit"]) // 1024)


def test_fingerprints(rows, results):
    bits = [brute_fingerprint(r[1] or "") for r in rows]
    roots = brute_components(bits)
    least = [min(rows[k][0] for k in range(len(rows)) if roots[k] == x) for x in roots]
    assert values(results["op3_simhash"], "doc_id", "fingerprint", "component_id") == sorted(((r[0], f"{b:016x}", m) for r, b, m in zip(rows, bits, least)), key=str)


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    symbols = [ord(c) for w in letters.split() for c in f"{w} "]
    out = []
    for i in range(len(symbols)):
        value = 0
        for n in (1, 2, 3)[: len(symbols) - i]:
            value = (value * 0x100000001B3 + symbols[i + n - 1] + n) % 2**64
            out.append(value * 0x9E3779B97F4A7C15 % 2**64 >> 48)
    return out


def test_languages_are_those_of_plain_naive_bayes(rows, results):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    counts, texts = {}, Counter()
    for i, t, lang, *_ in rows:
        if t is not None and lang is not None and not held(i):
            counts.setdefault(lang, Counter()).update(plain_grams(t))
            texts[lang] += 1
    langs = sorted(counts)
    totals = {x: sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS for x in langs}
    got = {r.doc_id: r for r in results["op4_langid"]}
    assert len(results["op4_langid"]) == len(rows)
    for i, t, *_ in rows:
        grams = plain_grams(t or "")
        assert got[i].held_out == held(i)
        if not grams:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        scale = min(1, langid.EVIDENCE / (len(langid.ORDERS) * sum(1 for c in t.lower() if c.isalpha()) + len(langid.ORDERS) * len("".join(c if c.isalpha() else " " for c in t.lower()).split())))
        log = {x: scale * sum(math.log((counts[x][g] + langid.SMOOTHING) / totals[x]) for g in grams) + math.log((texts[x] + 1) / (sum(texts.values()) + len(langs))) for x in langs}
        best = max(langs, key=lambda x: log[x])
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(math.exp(v - log[best]) for v in log.values()), rel=1e-3)


def test_quality_columns(rows, results):
    base = lambda t: (b := brute_base(t)) + (b[0] < 50 or 100 * b[4] > 50 * b[0],)
    got = results["op5_quality"]
    assert values(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want(rows, base)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_losses_and_targets(rows, results):
    good = lambda i: i == 2 or (i < 45 and i % 2 == 1 and i % 5 != 0)
    once = {r[0]: (r[0], r[1], good(r[0])) for r in rows}
    twice = (10_000, rows[3][1], good(3))  # the row that comes twice, under an id of its own
    losses = brute_losses([*once.values(), twice])
    for r in results["op6_lm_difference"]:
        a, b = losses[r.doc_id]
        assert (r.target_loss, r.background_loss, r.score) == pytest.approx((a, b, b - a), rel=1e-9) and r.n_tokens == len((once[r.doc_id][1] or "").split())
    assert len(results["op6_lm_difference"]) == len(rows)


def test_licence_columns(rows, results):
    def one(t):
        n, starts, hits = brute_licences(t)
        join = lambda labels: ",".join(sorted(set(labels)))
        kinds = {k for k, *_ in hits}
        score = 1.0 if "tag" in kinds else 0.9 if "base" in kinds else 0.6 if hits else 0.0
        return n, len(starts), min(starts, default=None), max(starts, default=None), join(x for k, x, _ in hits if k == "base"), join(x for _, x, _ in hits), score

    assert values(results["op7_licenses"], *[c.split()[0] for c in COLUMNS["op7_licenses"].split(", ")]) == want(rows, one)


def test_removed_bytes(rows, results):
    texts = [r[1] or "" for r in rows]
    short = [t if len(t) < 10_000 else "" for t in texts]  # the two long ones are alike all through, and nothing else has their windows
    told = [sum(len(r[a:z].split()) >= 51 for a, z in spans) for r, spans in brute_spans(short, 240)]
    expected = [(r[0], *x[:3], sha(x[3]), n) for r, x, n in zip(rows, brute_dedup(short, 400), told)]
    expected = [e if s == t else (e[0], len(t), len(t), 1, sha(""), int(" " in t.replace("\n", " "))) for e, s, t in zip(expected, short, texts)]
    assert values(results["op10_suffix_dedup"], *[c.split()[0] for c in COLUMNS["op10_suffix_dedup"].split(", ")]) == sorted(expected, key=str)

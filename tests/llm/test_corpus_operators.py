"""Each corpus operator against a brute-force twin on small tables with the awkward cases in them."""

import hashlib
import itertools
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vulnlake.llm import bpe, graph, langid, licenses, lm, media, packing, quality, simhash, suffixes
from vulnlake.llm.common import tokenizer_path

DRAW = random.Random(7)
WORDS = ["".join(DRAW.choice("abcdeéß") for _ in range(DRAW.randint(1, 7))) for _ in range(120)]
LONG = " ".join(DRAW.choice(WORDS) for _ in range(40_000))
TEXTS = [
    None, "", " ", "\n\t", "one", "Hello, world's  café 12\x1c3", "a <|endoftext|> b<|startoftext|>", "   three   blanks  ", "'start's' ΣΑΣ Σίσυφος İx²½",
    "\x85\xa0x 日本語テキスト 😀😀", "aaaaaaaaaaaaaaaaaaaaaaaaa", "word " * 200, LONG, "# $ * %" * 30, "Released under the MIT License.", "x" * 64, "y" * 63,
    *[" ".join(DRAW.choice(WORDS) for _ in range(n)) for n in (5, 49, 50, 60, 400, 900)],
]
TEXTS += TEXTS[-3:]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", "clash", True) for i, t in enumerate(TEXTS)]
    rows += [rows[-1], (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens string, kept boolean").repartition(3)


def expected(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def order(rows):
    return sorted(rows, key=str)


def empty(docs):
    return docs.filter("false")


def test_transport_streams(docs):
    parsed = media.digests(media.parse_streams(media.texts_to_streams(docs), ("doc_id", "n_bytes")))
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in parsed.collect()]
    want = []
    for i, t in expected(docs):
        b = t.encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert order(got) == order(want)
    assert media.parse_streams(media.texts_to_streams(empty(docs)), ("doc_id",)).count() == 0


def test_transport_stream_faults():
    payload = bytes(range(256)) * 100
    stream = media.mux(payload)
    whole = media.demux(stream)
    assert b"".join(u["data"] for u in whole["units"]) == payload and not whole["gaps"] and whole["programs"] == {1: 0x1000} and whole["streams"] == {0x100: 6}
    assert [u["pts"] for u in whole["units"]] == [3600 * i for i in range(7)] and [u["random"] for u in whole["units"]] == [i % 4 == 0 for i in range(7)]
    lost = media.demux(stream[: 188 * 6] + stream[188 * 7 :])
    assert lost["gaps"] == 1 and not lost["units"][0]["whole"]
    assert media.demux(b"xyz" + stream)["skipped"] == 3
    assert media.demux(stream[: 188 * 5] + stream[188 * 4 :])["gaps"] == 0  # a packet may come twice
    broken = bytearray(stream)
    broken[12] ^= 1
    assert media.demux(bytes(broken))["broken"] == 1
    assert media.demux(b"")["packets"] == 0


def test_tables_over_several_packets():
    def table(table_id, number, body, version=0, valid=1, part=0, parts=0):
        head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC0 | version << 1 | valid, part, parts]) + body
        return head + media.table_crc(head).to_bytes(4, "big")

    counts = {}

    def packets(pid, *sections):
        data, out = b"".join(sections), []
        ends = [sum(map(len, sections[:i])) for i in range(len(sections))]  # where sections begin
        while data:
            at = sum(map(len, sections)) - len(data)
            begins = [e for e in ends if at <= e < at + 183]
            body = (bytes([begins[0] - at]) if begins else b"") + data[: 183 if begins else 184]
            data = data[len(body) - bool(begins) :]
            counts[pid] = counts.get(pid, -1) + 1 & 15
            out.append(bytes([0x47, (0x40 if begins else 0) | pid >> 8, pid & 255, 0x10 | counts[pid]]) + body.ljust(184, b"\xff"))
        return b"".join(out)

    entry = lambda n: n.to_bytes(2, "big") + (0xE000 | 0x100 + n).to_bytes(2, "big")
    pat = [table(0, 1, b"".join(map(entry, range(1 + 60 * k, 61 + 60 * k))), part=k, parts=2) for k in range(3)]
    kinds = {n: n % 7 for n in range(700, 800)}
    row = lambda n: bytes([kinds[n]]) + (0xE000 | n).to_bytes(2, "big") + b"\xf0\2ab"
    pmt = table(2, 5, b"\xe1\0\xf0\3xyz" + b"".join(map(row, kinds)))
    stream = packets(0, *pat) + packets(0x105, pmt)
    found = media.demux(stream)
    assert found["programs"] == {n: 0x100 + n for n in range(1, 181)} and found["streams"] == kinds and not found["broken"] and not found["gaps"]
    gap = media.demux(stream[: -188 * 2] + stream[-188:])
    assert gap["streams"] == {} and gap["gaps"] == 1 and gap["broken"] == 1  # a map with a hole is none
    assert media.demux(stream[:-188])["broken"] == 1  # as is one that ends early
    later = stream + packets(0, table(0, 1, entry(7), version=1, valid=0))
    assert media.demux(later)["programs"] == found["programs"]  # not yet in force
    new = media.demux(later + packets(0, table(0, 1, entry(5), version=1)))
    assert new["programs"] == {5: 0x105} and new["streams"] == kinds
    assert media.demux(later + packets(0, table(0, 1, entry(7), version=1)))["streams"] == {}


def test_word_bpe(docs):
    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in expected(docs):
        ids = own.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), " ".join(map(str, ids)), own.decode(ids, skip_special_tokens=False)))
    assert order(tuple(r) for r in bpe.encode_words(docs).collect()) == order(want)
    assert bpe.encode_words(empty(docs)).count() == 0


def test_byte_bpe(docs):
    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = [(i, len(t.encode()), len(own.encode(t, add_special_tokens=False).ids)) for i, t in expected(docs)]
    assert order(tuple(r) for r in bpe.count_tokens(docs).collect()) == order(want)
    assert bpe.count_tokens(empty(docs)).count() == 0


def test_byte_bpe_random_strings():
    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    packer = bpe.IdPacker("byte_bpe_50k.json")
    for _ in range(400):
        t = "".join(DRAW.choice("ab 's \n\tÉx1²<|>Σ \x1c.,!") for _ in range(DRAW.randint(0, 60)))
        assert packer.pack(t) == np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_merges_of_equal_symbols():
    vocab = {c: i for i, c in enumerate(bpe.byte_letters())} | {"aa": 256, "aaa": 257, "ab": 258}
    merger = bpe.RankMerger({"model": {"vocab": vocab, "merges": [["a", "a"], ["aa", "a"], ["a", "b"]]}})
    assert merger.count([b"a" * n for n in range(1, 8)] + [b"aab", b"b"]).tolist() == [1, 1, 1, 2, 2, 3, 3, 2, 1]


def brute_components(bits):
    parent = list(range(len(bits)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(bits)), 2):
        if (bits[a] ^ bits[b]).bit_count() <= 2:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(bits))]


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    rows = expected(docs)
    bits = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(bits)
    want = [(i, f"{b:016x}", min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None)) for (i, _), b, r in zip(rows, bits, roots)]
    assert order(tuple(r) for r in simhash.near_duplicates(docs).collect()) == order(want)
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_rows_of_a_frequent_fingerprint_are_dealt(spark, monkeypatch):
    rows = [(i if i % 3 else None, "a b c d" if i < 300 else f"t{i} u{i} v{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda: sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    plain = got()
    monkeypatch.setattr(simhash, "HOT", 20, raising=True)
    assert got() == plain and len(plain) == 400


@pytest.mark.parametrize("longest", [2, 32])
def test_links_of_crowded_lists(spark, monkeypatch, longest):
    monkeypatch.setattr(simhash, "LONGEST", longest)
    seeds = [DRAW.getrandbits(64) for _ in range(6)]
    bits = list({s ^ (1 << DRAW.randrange(64)) ^ (1 << DRAW.randrange(64)) for s in seeds for _ in range(25)} | set(seeds))
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    df = spark.createDataFrame([(b,) for b in signed], "bits long")
    found = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    groups = lambda labels: sorted(sorted(signed[i] for i in range(len(bits)) if labels[i] == x) for x in set(labels))
    assert groups(brute_components(bits)) == groups([found.get(b, b) for b in signed])


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(201)) and all(roots[k] == 1000 for k in range(1000, 1100)) and 5000 not in roots


def test_language(spark, docs):
    langs = {"aa": "abcd", "bb": "cdef"}
    draw = random.Random(1)
    rows = [(i, " ".join("".join(draw.choice(langs[x]) for _ in range(5)) for _ in range(30)), x) for i, x in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predicted(df, model).collect()}
    tested = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert tested and all(got[i].held_out == (i in set(tested)) for i, _, _ in rows)
    assert all(got[i].lang_pred == rows[i][2] and 0 <= got[i].score <= 1 for i in tested)
    odd = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == "und" and odd[0].score == 0 and odd[13].lang_pred == "und" and len(odd) == docs.select("doc_id").distinct().count()
    nothing = langid.fit(empty(df))
    assert {r.lang_pred for r in langid.predicted(df, nothing).collect()} == {"und"} and langid.predicted(empty(df), model).count() == 0


def test_language_scores_match_a_plain_sum():
    texts = ["Ab c", None, "9", "é é"]
    found, length = langid.grams(texts)
    assert length.tolist() == [5, 0, 0, 4]
    symbols = "ab c "
    for k, n in enumerate(langid.ORDERS):
        inside = [i + n <= 5 for i in range(5)]
        assert [x != langid.BUCKETS for x in found[:5, k].tolist()] == inside, (n, symbols)


def brute_base(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_quality(docs):
    rows = quality.judged(docs).collect()
    got = order((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = [(i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in expected(docs) for b in [brute_base(t)]]
    assert got == order(want) and not any(r.kept and r.base_failed for r in rows)
    assert quality.judged(empty(docs)).count() == 0


def test_quality_repeats_at_random():
    for _ in range(300):
        t = "".join(DRAW.choice(["a", "b", " ", " ", "\n", "c d e "]) for _ in range(DRAW.randint(0, 60)))
        assert quality.base_measures(t)[:5] == brute_base(t)


def test_quality_limits_follow_the_group(spark):
    plain = [(i, " ".join(f"w{100 + i}x{k}" for k in range(80)), "en", "s") for i in range(100)]
    marked = [(1000 + i, " ".join(f"w{100 + i}x{k}###" for k in range(80)), "en", "s") for i in range(3)]
    of_marks = [(2000 + i, " ".join(f"v{100 + i}x{k}###" for k in range(80)), "en", "marks") for i in range(100)]
    df = spark.createDataFrame(plain + marked + of_marks, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judged(df).collect()}
    assert all(kept[i] for i in range(100)) and not any(kept[1000 + i] for i in range(3)) and all(kept[2000 + i] for i in range(100))


def test_sketch_quartiles_are_close(spark):
    values = [DRAW.randrange(1, 5000) for _ in range(1000)]
    df = spark.createDataFrame([("en", v) for v in values], "lang string, m long")
    q = quality.quartiles(quality.sketches(df, ["lang"], ["m"]), ["lang"]).first()
    assert q.total == 1000 and all(abs(a - b) <= b / 16 for a, b in ((q.lower, sorted(values)[249]), (q.upper, sorted(values)[749])))


def brute_losses(rows):
    """Target and background loss of each document by the counts of all others."""
    split = {i: (t or "").lower().split() for i, t, _ in rows}
    counts = [Counter(), Counter()]
    for i, _, target in rows:
        for k in (0, 1)[not target :]:
            counts[k].update(split[i])
            counts[k].update(zip(split[i], split[i][1:]))
    size = max(1 << lm.WORD_BITS, sum(isinstance(w, str) for w in counts[1]))
    totals = [sum(n for w, n in c.items() if isinstance(w, str)) for c in counts]
    out = {}
    for i, _, target in rows:
        own = Counter(split[i]) + Counter(zip(split[i], split[i][1:]))
        both = []
        for k, c in enumerate(counts):
            held = k or target
            left = lambda x: c[x] - (own[x] if held else 0)  # noqa: B023, E731
            one = lambda w: (left(w) + 1) / (totals[k] - (len(split[i]) if held else 0) + size)  # noqa: B023, E731
            p = [one(w) for w in split[i][:1]] + [(left((a, b)) + lm.BACKING * one(b)) / (left(a) + lm.BACKING) for a, b in zip(split[i], split[i][1:])]
            both.append(float(-np.log(p).mean()) if p else 0.0)
        out[i] = tuple(both)
    return out


def test_language_model_difference(spark, docs):
    rows = [(i, " ".join(DRAW.choice(WORDS[:20] if i % 2 else WORDS[60:80]) for _ in range(50)), i % 2 == 1 and i < 30) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(df).collect()}
    assert min(got[i].score for i in range(1, 60, 2)) > max(got[i].score for i in range(0, 60, 2))
    want = brute_losses(rows)
    assert all((got[i].target_loss, got[i].background_loss, got[i].score) == pytest.approx((a, b, b - a), rel=1e-9) for i, (a, b) in want.items())
    odd = lm.cross_entropy_difference(docs.withColumn("target", F.lit(None).cast("boolean")))
    assert odd.filter("doc_id < 4 and (n_tokens <> 0 or score <> 0)").count() == 0 and odd.count() == docs.count()
    assert lm.cross_entropy_difference(empty(df)).count() == 0


def test_language_model_counts_more_words_than_any_fixed_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400_000, raising=False)
    draw, n = random.Random(5), 400
    rows = [(i, " ".join(f"w{draw.randrange(2_000_000)}" for _ in range(1000)), i % 4 == 0) for i in range(n)]
    got = {r.doc_id: r for r in lm.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(4)).collect()}
    assert len({w for _, t, _ in rows for w in t.split()}) > 2**lm.WORD_BITS and len(got) == n
    want = brute_losses(rows)
    assert all((got[i].target_loss, got[i].background_loss) == pytest.approx(want[i], rel=1e-9) for i in want)


def test_no_message_between_blocks_and_buckets_is_empty():
    text = " ".join(WORDS)
    part = pa.table({"block": [3], "doc_id": [1], "text": [pa.compress(text.encode(), "zstd", asbytes=True)], "n_bytes": [len(text.encode())], "target": [True]})
    sent = lm.asked(part, 100_000)
    distinct = len(set(WORDS)) + len(set(zip(WORDS, WORDS[1:])))
    assert sent.num_rows <= distinct == sum(sent["n_keys"].to_pylist()) and min(sent["n_keys"].to_pylist()) > 0
    assert lm.asked(part.set_column(2, "text", [[b""]]).set_column(3, "n_bytes", [[0]]), 5).num_rows == 0


def test_licenses(spark, docs):
    cases = {
        "The MIT\nlicense, mit-license; Apache (License)": (3, 1, 5, {"mit", "apache"}),
        "GNU General Public License": (1, 1, 1, {"gpl"}),
        "commit license amit license mit licenses": (0, None, None, set()),
        "mit license mit license": (2, 0, 2, {"mit"}),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    for r in licenses.license_hits(df).collect():
        base = [h for h in r.hits if h.kind == "base"]
        n, first, last, labels = list(cases.values())[r.doc_id]
        starts = [h.first_word for h in base]
        assert (len(base), min(starts, default=None), max(starts, default=None), {h.label for h in base}) == (n, first, last, labels)
    assert licenses.license_hits(docs).count() == docs.count() and licenses.license_hits(empty(docs)).count() == 0
    tagged = licenses.scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0 */\nx")
    assert {h["label"] for h in tagged["hits"]} == {"mit", "gpl", "apache"} and tagged["hits"][0]["permissive"]


def brute_licences(text):
    """n_words, first words of base phrases, and (kind, label, first word) of all hits."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    words, hits = [m.group() for m in found], []
    for kind, table in (("base", licenses.BASE), ("notice", licenses.NOTICES)):
        for phrase, label in table.items():
            p = phrase.split()
            hits += [(kind, label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
    for m in re.finditer(r"spdx-license-identifier: *([^\n]*)", low):
        ids = re.match(r"[a-z0-9.+-]+(?: or [a-z0-9.+-]+)*", m[1])
        first = sum(w.start() < m.start() for w in found)
        hits += [("tag", x, first) for x in sorted({licenses.family(t) for t in ids[0].split(" or ")} if ids else set())]
    return len(words), sorted(i for k, _, i in hits if k == "base"), sorted(hits)


def test_licences_in_random_texts(spark):
    draw = random.Random(9)
    bits = [*licenses.BASE, *licenses.NOTICES, "MIT License", "Apache-License", "general\npublic\tLICENSE", "é", "mit", "license", "apache", "general", "public", "x1", "--", "\x1c", "İ", "\x85"]
    tags = ["\nSPDX-License-Identifier: MIT\n", "\n// spdx-license-identifier: GPL-2.0-only or BSD-3-Clause\n", "\nSPDX-License-Identifier:\n", "\nSPDX-License-Identifier: Zlib"]
    texts = ["".join(draw.choice(bits if draw.random() < 0.9 else tags) + draw.choice([" ", "  ", "\n", ", ", "_"]) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    for t in texts:
        got = licenses.scan(t)
        n, starts, hits = brute_licences(t)
        assert (got["n_words"], sorted(h["first_word"] for h in got["hits"] if h["kind"] == "base")) == (n, starts)
        assert sorted((h["kind"], h["label"], h["first_word"]) for h in got["hits"]) == hits
    long = "the MIT license and more " * 40_000 + "\nSPDX-License-Identifier: ISC"
    got = licenses.scan(long)
    assert got["n_words"] == 200_004 and len(got["hits"]) == 40_001 and got["hits"][-2]["first_word"] == 199_996


@pytest.mark.parametrize("text,order_,free", [
    ("MIT or GPL-3.0 and BSD-2-Clause", "mit gpl-3.0 bsd-2-clause and or", True), ("(MIT or GPL-3.0) and GPL-2.0", "mit gpl-3.0 or gpl-2.0 and", False),
    ("GPL-2.0 with X and MIT", "gpl-2.0 x with mit and", False), ("MIT or", None, None), ("(MIT", None, None), ("MIT GPL", None, None), ("", None, None),
])
def test_expressions(text, order_, free):
    got = licenses.postfix(text.encode())
    assert got == (order_.split() if order_ else None) and (got is None or licenses.evaluate(got)[1] == free)


def test_long_expressions():
    parts = ["MIT"] * 100 + ["GPL-2.0"]
    for line in (" AND ".join(parts), "(" + " AND ".join(parts) + ") */", "(" * 300 + "MIT AND GPL-2.0" + ")" * 300):
        hits = licenses.scan(f"SPDX-License-Identifier: {line}\nx")["hits"]
        assert [(h["label"], h["permissive"]) for h in hits if h["kind"] == "tag"] == [("gpl", False), ("mit", False)]
    draw = random.Random(3)
    for _ in range(3000):
        tokens = [draw.choice(["(", ")", "a", "b", "or", "and", "with"]) for _ in range(draw.randint(0, 12))]
        orders = [o for n in range(len(tokens), 0, -1) if (o := licenses.postfix(" ".join(tokens[:n]).encode()))]
        assert licenses.expression_at(" ".join(tokens).encode()) == (orders[0] if orders else None)


def test_long_lines_of_tags_take_linear_time():
    def seconds(n):
        text = "SPDX-License-Identifier: MIT and " * n
        began = time.perf_counter()
        hits = licenses.scan(text)["hits"]
        assert len(hits) == n and hits[-1]["first_word"] == 5 * (n - 1)
        return time.perf_counter() - began

    seconds(10)
    assert seconds(120_000) < 12 * seconds(20_000) + 1  # 36 times as long if it grew with the square
    one = "SPDX-License-Identifier: " + " or ".join(["MIT", "GPL-2.0"] * 50_000)
    assert {h["label"] for h in licenses.scan(one)["hits"]} == {"mit", "gpl"}
    assert licenses.scan("SPDX-License-Identifier: MIT or SPDX-License-Identifier: ISC")["hits"][0]["expression"] == "mit"


@pytest.mark.parametrize("name,label", [
    ("mit", "mit"), ("mit-0", "mit"), ("mitre", "other"), ("mitnothing", "other"), ("iscsi", "other"), ("isc", "isc"), ("gpl-2.0+", "gpl"), ("gplv3", "gpl"), ("gplvx", "other"), ("apache2", "apache"),
    ("cc-by-4.0", "cc"), ("cc0-1.0", "cc0"), ("ccx", "other"), ("cc-pddc", "public-domain"), ("bsd-3-clause", "bsd"), ("zlib,", "zlib"), ("x" * 100_000, "other"),
])
def test_families_have_borders(name, label):
    assert licenses.family(name) == label


def test_packing(spark, docs):
    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = packing.best_fit_pack(docs, per_task=3).collect()
    ids = {i: own.encode(t, add_special_tokens=False).ids + [2] for i, t in expected(docs)}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 1024 and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 1024)
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in expected(docs) for _ in range(-(-len(ids[i]) // 1024)))
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024 and packing.best_fit_pack(empty(docs)).count() == 0


def test_plan_equals_best_fit_on_pieces():
    for _ in range(200):
        capacity = DRAW.choice([10, 37, 64])
        pieces = [DRAW.randint(1, capacity) for _ in range(DRAW.randint(0, 120))]
        plan = packing.plan_slots(Counter(pieces), capacity)
        free = []
        for p in sorted(pieces, reverse=True):
            fits = [f for f in free if f >= p]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - p)
            else:
                free.append(capacity - p)
        used = {}
        for length, first, last, sequence, each, offset in plan:
            for r in range(first, last + 1):
                used.setdefault(sequence + (r - first) // each, []).append((offset + (r - first) % each * length, length))
        assert len(used) == len(free) and sorted(x for s in used.values() for _, x in s) == sorted(pieces)
        for spans in used.values():
            at = 0
            for start, size in sorted(spans):
                assert start == at
                at += size
            assert at <= capacity


def test_suffix_array():
    for _ in range(1500):
        text = [DRAW.randint(1, DRAW.choice([1, 2, 3, 9])) for _ in range(DRAW.randint(0, 40))] + [0]
        got = suffixes.grouped_suffix_array(text)
        assert got == sorted(range(len(text)), key=lambda i: text[i:])
        rank, shared = suffixes.shared_lengths(text, got)
        assert [got[r] for r in rank] == list(range(len(text)))
        asks = [(i, d) for i in range(len(text)) for d in range(1, len(text) - i)]
        if asks:
            least, more = suffixes.first_alike(rank, shared, *np.array(asks).T)
            for (i, d), first, others in zip(asks, least, more):
                alike = [rank[j] for j in range(len(text)) if text[j : j + d] == text[i : i + d]]
                assert first == min(alike) and others == (len(alike) > 1)


def brute_spans(texts, length):
    """Marks of the bytes under windows that start twice."""
    raws = [t.encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((r, [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]))
    return out


def brute_dedup(texts, length, least_words=0):
    out = []
    for r, spans in brute_spans(texts, length):
        spans = [(a, z) for a, z in spans if len(r[a:z].split()) >= least_words]
        inside = {k for a, z in spans for k in range(a, z)}
        out.append((len(r), len(inside), len(spans), bytes(b for k, b in enumerate(r) if k not in inside)))
    return out


def near_texts():
    base = [" ".join(DRAW.choice(WORDS) for _ in range(DRAW.randint(20, 120))) for _ in range(8)]
    texts = [None, "", "short", "a" * 900, "a" * 99, "ab" * 200, "é" * 150]
    for _ in range(70):
        words = DRAW.choice(base).split()
        for _ in range(DRAW.randint(0, 3)):
            words[DRAW.randrange(len(words))] = DRAW.choice(WORDS)
        texts.append(" ".join(words) + (" " + DRAW.choice(base) if DRAW.random() < 0.3 else ""))
    return texts


@pytest.mark.parametrize("crowd", [3, 4000])
def test_suffix_dedup(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "PER_BUCKET", 25)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rows = [(i if i % 30 else None, t, "clash") for i, t in enumerate(near_texts())] + [(3, "a" * 900, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string").coalesce(2)
    with pytest.raises(ValueError):
        suffixes.deduplicated(df, 100, keep=("n_removed",))
    texts = [r[1] or "" for r in rows]
    told = [sum(len(r[a:z].split()) >= 12 for a, z in spans) for r, spans in brute_spans(texts, 70)]
    for length, least_words in ((100, 0), (100, 20)):
        got = suffixes.deduplicated(df, length, least_words=least_words, passage=(70, 12)).collect()
        want = [(r[0], *x, n) for r, x, n in zip(rows, brute_dedup(texts, length, least_words), told)]
        assert order((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_passages) for r in got) == order(want)
    assert suffixes.deduplicated(df.filter("false"), 100).count() == 0


def test_suffix_dedup_at_400_bytes(spark):
    passages = [" ".join("".join(DRAW.choice("abcdefgh") for _ in range(DRAW.randint(2, 9))) for _ in range(n)) for n in range(40, 130, 3)]
    fill = lambda: " ".join("".join(DRAW.choice("mnopqrs") for _ in range(DRAW.randint(2, 9))) for _ in range(DRAW.randint(5, 200)))
    texts = [f"{fill()} {p} {fill()}" for p in passages for _ in range(DRAW.randint(1, 4))] + ["z" * 399, "z" * 400, "y" * 401, "w" * 5000]
    rows = list(enumerate(texts))
    got = suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 400, passage=suffixes.PASSAGE).collect()
    told = [sum(len(r[a:z].split()) >= 51 for a, z in spans) for r, spans in brute_spans(texts, 240)]
    want = [(i, *x, n) for (i, _), x, n in zip(rows, brute_dedup(texts, 400), told)]
    assert order((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_passages) for r in got) == order(want) and any(told)


def test_the_suffix_array_decides(monkeypatch):
    base = ["".join(DRAW.choice("abcdefgh ") for _ in range(600)) for _ in range(3)]
    runs = [b[: DRAW.randint(0, 100)] + "".join(DRAW.choice("xyz") for _ in range(DRAW.randint(0, 5))) + b for b in base for _ in range(6)]
    keys, windows = np.zeros(len(runs), np.int64), np.array([len(r) - 399 for r in runs])
    flags = lambda: np.concatenate(suffixes.Phrases([r.encode() for r in runs], keys).repeated(np.zeros(len(runs), np.int64), windows, 400))
    seen = Counter(r[p : p + 400] for r in runs for p in range(len(r) - 399))
    right = flags()
    assert right.tolist() == [seen[r[p : p + 400]] > 1 for r in runs for p in range(len(r) - 399)]
    monkeypatch.setattr(suffixes, "grouped_suffix_array", lambda text: list(range(len(text))))
    assert (flags() != right).any()


def test_vocabulary_is_a_parameter(tmp_path):
    with open(tokenizer_path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    place = tmp_path / "own.json"
    place.write_text(json.dumps(spec))
    assert bpe.IdPacker(str(place)).pack("a b") == bpe.IdPacker("byte_bpe_50k.json").pack("a b")


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_LINKS", 20)
    draw = random.Random(4)
    pairs = [(1, k) for k in range(2, 200)] + [(k, k + 300) for k in range(100, 130)] + [(draw.randrange(1000, 1400), draw.randrange(1000, 1400)) for _ in range(150)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: root(i) for i in linked}

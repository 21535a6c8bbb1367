"""Operators without an SQL form, against brute force, round trips and held-out rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from terravia.llm import fingerprint, langid, nearcopies, packing, pii, quality, sentencepiece, simhash
from tests.conftest import SF, SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"
TEXTS = [None, "", " \n", "a", "a b", "A b", "one two three", "one two three", "é漢🙂 " * 40, "x" * 70_000, "1234 5678 !!", "² ½ Ⅷ"]


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, None if i % 5 == 0 else "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)], DOCS)


def real(spark, n=None):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs if n is None else docs.where(f"doc_id < {n}")


# -- SimHash


def brute_simhash(rows, shingle, distance):
    prints = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def near_copies(seed=3):
    """Copies with few and many changed words, in one large group and small ones, beside strangers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    out = []
    for size in (60, 5, 2, 1, 1, 1):
        base = [word() for _ in range(300)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 9])):
                copy[r.randrange(300)] = word()
            out.append(" ".join(copy))
    return out + TEXTS


@pytest.mark.parametrize("cap", [2048, 1])
def test_simhash_brute_force(spark, cap):
    texts = near_copies()
    docs = docs_of(spark, texts)
    want = brute_simhash(list(enumerate(texts)), 3, 2)
    got = {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.components(docs, bucket_cap=cap).collect()}
    assert got == want


@pytest.mark.parametrize("distance, segments, cap", [(3, 2, 2048), (3, 2, 1), (4, 3, 2048), (1, 2, 2048)])
def test_simhash_other_distances(spark, distance, segments, cap):
    texts = near_copies(5)[:70]
    got = {r.doc_id: r.component_id for r in simhash.components(docs_of(spark, texts), 3, distance, segments, cap).collect()}
    assert got == {i: c for i, (_, c) in brute_simhash(list(enumerate(texts)), 3, distance).items()}


def test_simhash_whole_table(spark):
    rows = real(spark).select("doc_id", "text").collect()
    want = brute_simhash([(r.doc_id, r.text) for r in rows], 3, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10(real(spark)).collect()}
    assert got == want


def test_simhash_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_long_texts_are_whole():
    words = [f"w{i}" for i in range(100_000)]
    (a,), (b,) = simhash.fingerprints([" ".join(words)], 3), simhash.fingerprints([" ".join(words[:60_000])], 3)
    hs = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(99_998)], dtype=np.uint64)
    want = sum(1 << k for k in range(64) if 2 * int(((hs >> np.uint64(k)) & np.uint64(1)).sum()) > len(hs))
    assert int(a) & (2**64 - 1) == want != int(b) & (2**64 - 1)


def test_simhash_nulls_repeats_empty(spark):
    docs = docs_of(spark, ["same text here now", "same text here now", "other words are here", None], [None, 7, 7, 9])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.op10(docs).collect()), key=str)
    assert got == [(7, 7), (7, 7), (9, 9), (None, None)]
    assert simhash.op10(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or -1, r.text) for r in nearcopies.stage(docs).where("text IS NOT NULL").collect()) == [(-1, "same text here now"), (7, "other words are here"), (7, "same text here now")]
    assert nearcopies.stage(docs).where("text IS NULL").count() == 1


# -- near copies


def brute_near_copies(rows):
    """Components of a similarity of 0.8 or more over five-word shingles, every pair compared."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_near_copies_made(spark):
    texts = near_copies()
    docs = docs_of(spark, texts)
    want = brute_near_copies(list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in nearcopies.groups(docs).collect()} == want
    left = nearcopies.stage(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(want.values())


def test_near_copies_whole_table(spark):
    rows = real(spark).select("doc_id", "text").collect()
    want = brute_near_copies([(r.doc_id, r.text) for r in rows])
    assert {r.doc_id: r.component_id for r in nearcopies.groups(real(spark)).collect()} == want
    assert len(set(want.values())) < len(want)


def test_near_copies_keep_different_texts_of_one_id(spark):
    """Two texts under one id stay both; of rows that repeat id and text one stays, and always the same."""
    docs = docs_of(spark, ["a b c d e f g", "h i j k l m n", "a b c d e f g", "h i j k l m n"], [1, 1, 2, 1]).withColumnRenamed("key", "__d")
    docs = docs.withColumn("__d", F.when(F.col("lang").isNull(), "first").otherwise("second"))
    runs = [sorted((r.doc_id, r.text, r["__d"]) for r in nearcopies.stage(docs.repartition(n)).collect()) for n in (1, 3)]
    assert runs[0] == runs[1] == [(1, "a b c d e f g", "first"), (1, "h i j k l m n", "second")]
    assert sorted((r.doc_id, r.component_id) for r in nearcopies.groups(docs).collect()) == [(1, 1), (1, 1), (1, 1), (2, 1)]


def test_near_copies_long_text():
    long = " ".join(f"w{i}" for i in range(100_000))
    a, b = nearcopies.shingle_set(long), nearcopies.shingle_set(long + " more")
    assert len(a) == 99_996 and len(b) == 99_997 and set(a) < set(b)
    assert (nearcopies.band_values([a]) == nearcopies.band_values([b])).mean() > 0.9


def test_near_copies_empty(spark):
    assert nearcopies.groups(docs_of(spark, TEXTS).limit(0)).count() == 0


def test_near_copies_bitmaps_bound_the_difference():
    """Two bitmaps never differ in more bits than the sets do in members, and a pair just under 0.8 is mostly ruled out."""
    r = random.Random(4)
    ruled_out = 0
    for size in (0, 1, 30, 150, 3000):
        for changed in (0, 1, size // 4, size):
            a = {r.getrandbits(63) for _ in range(size)}
            b = set(sorted(a)[changed:]) | {r.getrandbits(63) for _ in range(changed)}
            x, y = (nearcopies.parities(np.array(sorted(s), dtype=np.uint64)) for s in (a, b))
            bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            assert bits <= len(a ^ b) and bits % 2 == len(a ^ b) % 2
            ruled_out += size == 150 and changed == size // 4 and 9 * bits > len(a) + len(b)
    assert ruled_out == 1


# -- language


def test_language_held_out(spark):
    rows = langid.op1(real(spark)).join(real(spark).select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.98
    long = [r for r in held if len(r.text) > 200]
    assert sum(r.lang_pred == r.lang for r in long) / len(long) >= 0.995
    assert not any(r.rejected for r in long)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_brute_force(spark):
    """Each text with each dictionary, one after the other."""
    import zstandard

    docs = real(spark, 250)
    learned = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(learned.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in langid.op1(docs).collect()}
    for r in docs.collect():
        plain = re.sub(r"[\W\d_]+", " ", r.text.lower()).strip().encode()
        if not plain:
            continue
        sizes = {}
        for lang, content in model:
            params = langid.parameters()
            made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[lang] = sum(len(made.compress(plain[k : k + langid.CHUNK])) for k in range(0, len(plain), langid.CHUNK))
        best, second = sorted(sizes.values())[:2]
        assert sizes[got[r.doc_id].lang_pred] == best
        assert got[r.doc_id].rejected == ((second - best) / second < langid.MIN_GAP)


def test_language_odd_rows(spark):
    got = {r.doc_id: r for r in langid.op1(docs_of(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        none = not any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == none, t
        assert not none or (got[i].score == 0 and got[i].rejected)
    assert langid.op1(docs_of(spark, TEXTS).limit(0)).count() == 0
    unlabelled = docs_of(spark, TEXTS).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.op1(unlabelled).collect()} == {"und"}


def test_language_takes_no_notice_of_copies(spark):
    docs = real(spark).select("doc_id", "text", "lang")
    one = docs.where("lang = 'en' AND length(text) > 300").orderBy("doc_id").limit(1)
    copies = one.crossJoin(spark.range(10_000).select("id")).select((F.col("id") * 4 + 100_000).alias("doc_id"), "text", "lang")
    learned = docs.where(~langid.held_out(F.col("doc_id")))
    assert langid.fit(learned.unionByName(one)) == langid.fit(learned.unionByName(one).unionByName(copies))


def brute_dictionary(rows, lang):
    """The excerpts of a language in order of their texts' hashes, before pieces of other languages are left out."""
    mine = {}
    for text, hash_ in ((t, h) for t, lg, h in rows if lg == lang and any(c.isalpha() for c in t or "")):
        at = max(1, int((len(text) - langid.EXCERPT) / 2))
        cut = text[at - 1 : at - 1 + langid.EXCERPT]
        mine[cut] = min(hash_, mine.get(cut, hash_))
    return [langid._plain(cut) for _, cut in sorted((h, c) for c, h in mine.items())[: langid.PER_LANG]]


def test_language_dictionaries_made_plainly(spark):
    docs = real(spark).where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    rows = [(r.text, r.lang, r.h) for r in docs.withColumn("h", F.xxhash64("text")).collect()]
    langs = sorted({lang for _, lang, _ in rows if lang})
    parts = {lang: brute_dictionary(rows, lang) for lang in langs}
    model = dict(langid.fit(docs))
    order = [lang for lang, _ in langid.fit(docs)]
    good = langid._trusted({lang: parts[lang] for lang in order})
    assert model == {lang: b" ".join(good[lang])[: langid.DICT_BYTES] for lang in langs}


def test_language_ignores_labels_of_held_out_rows(spark):
    docs = real(spark, 300)
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(langid.op1(docs).collect()) == sorted(langid.op1(changed).collect())


# -- personal data

P = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(P[kind], text or ""):
            v, d = m[0], re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind, v))
    return sorted(out)


HARD = [
    "a@b.c_d@e.f x@y.z.", "a@b a@b..c a@b.c.", "@x.y a@.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255", "4539 1488 0343 6467 and 4539-1488-0343-6467 45391488034364670000",
    "é🙂 +1 (555) 010-9999 +1() +44 20 7946 0958 ext", "+1 555 010 9999.10.1.1.1@h.io", "9" * 50_000, "a" * 50_000 + "@x.y", "x@" + "a." * 20_000 + "b", "1.1.1." * 5_000, "+1(((((((" * 1_000, "0 " * 30_000,
    "4111111111111111a 4111-1111 1111-1111", "A%b+c-d@e-f.g-h\nq@w.e",
] + TEXTS


def listed(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind, _ in spans)


def check_base(rows, texts):
    for r in rows:
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), (texts[r.doc_id] or "")[:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in pii.KINDS]
        assert set(listed(want).split(",")) - {""} <= set(r.spans.split(","))


def test_pii_base_spans(spark):
    check_base(pii.op3(docs_of(spark, HARD)).collect(), dict(enumerate(HARD)))
    rows = real(spark).select("doc_id", "text").collect()
    check_base(pii.op3(real(spark)).collect(), {r.doc_id: r.text for r in rows})


WORD = re.compile(r"[^\W\d_][\w]+")


def brute_levels(kind, v):
    d = re.sub("[^0-9]", "", v)
    value, group = {"email": (v.lower(), v.lower().split("@")[-1]), "ip": (v, ".".join(v.split(".")[:2])), "card": (d, d[:6]), "phone": (d, d[:-4])}[kind]
    return f"{kind}:{value}", f"{kind} of {group}", kind


def brute_around(text):
    """(levels of the entity, term, start, end) of the six words on either side of each entity, outside all of them."""
    base, out = brute_base(text), []
    for s, _, e, k, v in base:
        left = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text[:s])][-6:]
        right = [(e + m.start(), e + m.end(), m[0]) for m in WORD.finditer(text[e:])][:6]
        out += [(brute_levels(k, v), w.lower(), x, y) for x, y, w in left + right if not any(x < b[2] and b[0] < y for b in base)]
    return out


def brute_disclosing(texts):
    """The same estimate, pair by pair."""
    n, n_c, n_t, pairs, seen, holds = len(texts), Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for text in texts:
        mine = {x for _, _, _, k, v in brute_base(text) for x in brute_levels(k, v)}
        n_c.update(mine)
        for x in mine:
            holds[x].add(text)
        n_t.update({m[0] for m in WORD.finditer((text or "").lower())})
        near = {(c, w) for three, w, _, _ in brute_around(text) for c in three}
        for p in near:
            pairs[p] += 1
            seen[p].add(text)

    def low(c, t):
        """The share that lies 1.96 standard errors of its own under what was seen in d different texts, found by halving."""
        seen_share, d = pairs[c, t] / n_t[t], len(seen[c, t])
        cases, a, b = d / seen_share, 0.0, seen_share
        for _ in range(200):
            m = (a + b) / 2
            a, b = (m, b) if seen_share - m > 1.96 * (m * (1 - m) / cases) ** 0.5 else (a, m)
        return b

    share = lambda c, t: log2(n * low(c, t) / n_c[c]) / log2(n / n_c[c])
    return {(c, t): share(c, t) for c, t in pairs if len(seen[c, t]) >= pii.LEAST_TEXTS and len(holds[c]) > 1 and n_c[c] < n and share(c, t) >= pii.GENERALISE}


def brute_spans(texts):
    """The whole spans column: every occurrence of a disclosing term outside the base spans."""
    told, out, best = brute_disclosing(texts), [], {}
    for (_, t), v in told.items():
        best[t] = max(best.get(t, 0), v)
    for text in texts:
        base, clear = brute_base(text), text or ""
        for x, _, y, _, _ in base:
            clear = clear[:x] + " " * (y - x) + clear[y:]
        extra = [(m.start(), 4, m.end(), "removed" if best[m[0].lower()] >= pii.REMOVE else "term", "") for m in WORD.finditer(clear) if m[0].lower() in best]
        out.append(listed(sorted(base + extra)))
    return out


def planted():
    """Names that stand with one entity each, in several texts; words that stand once near one; and texts without either."""
    r = random.Random(11)
    word = lambda: "".join(r.choices("bcdfghklmnprstvz", k=9))
    plain = [f"the usual words of a text number {word()} call at the house today and then {word()} is away so" for _ in range(400)]
    names = [(n, e) for n, e in [("Zorblat", "+1 555 010 9999"), ("Quuxel", "q.u@mail.example"), ("Vimbor", "10.20.30.40")] for _ in range(5)]
    names += [("Dremmel", "4539 1488 0343 6467")] * 6
    held = [f"{word()} call {n} of the house at {e} today {word()} then {word()}" for n, e in names]
    once = [f"{word()} {word()} w{k}@host{k}.example {word()} {word()}" for k in range(60)]
    return plain + held + once + ["Zorblat is away and so is Quuxel", "a vimbor"]


def test_pii_disclosing_terms(spark):
    texts = planted() + planted()[400:403] + ["10.20.30.40Vimbor5 xZorblat Zorblat@a.b"]
    docs = docs_of(spark, texts)
    found = pii.found_spans(docs)
    got = {(r.entity, r.term): round(r.disclosure, 9) for r in pii.disclosing(docs, found).collect()}
    assert got == {k: round(v, 9) for k, v in brute_disclosing(texts).items()}
    assert {("phone:15550109999", "zorblat"), ("email:q.u@mail.example", "quuxel"), ("ip:10.20.30.40", "vimbor")} <= set(got)
    assert {t for _, t in got} == {"zorblat", "quuxel", "vimbor", "dremmel"}, "neither usual words nor such as stand once near an entity"
    assert {r.term: r["name"] for r in pii.marks(docs, found).collect()} == {"zorblat": "term", "quuxel": "term", "vimbor": "term", "dremmel": "removed"}
    assert [r.spans for r in sorted(pii.op3(docs).collect(), key=lambda r: r.doc_id)] == brute_spans(texts)
    masked = {r.doc_id: r.text for r in pii.stage(docs).collect()}
    assert "Zorblat" not in masked[400] and "+1 555" not in masked[400] and "[PHONE]" in masked[400]
    assert masked[481] == "[NAME] is away and so is [NAME]" and masked[482] == "a [TERM]"
    assert "Dremmel" not in masked[415] and "[CARD]" in masked[415] and " call  of " in masked[415]
    assert all(masked[i] == texts[i] for i in range(400))


def test_pii_terms_by_shuffle_and_generalised(spark, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    texts = planted()
    spans, some = pii.all_spans(docs_of(spark, texts), remove=2.0)
    assert some and {a["name"] for r in spans.collect() for a in r.added} == {"term"}
    assert [r.spans for r in sorted(pii.op3(docs_of(spark, texts)).collect(), key=lambda r: r.doc_id)] == brute_spans(texts)


def test_pii_thin_evidence_marks_nothing(spark):
    texts = planted()
    alone = [t for t in texts if not re.search("Zorblat|Quuxel|Vimbor|vimbor|Dremmel", t)]
    copies = [t for t in texts if "Zorblat" in t][:2] * 50
    spans, some = pii.all_spans(docs_of(spark, alone + copies))
    assert not some, "neither single mentions nor copies of two texts are evidence"
    assert spans.count() == len(alone + copies)


def test_pii_real_terms(spark):
    rows = sorted(real(spark).select("doc_id", "text").collect())
    texts = [r.text for r in rows]
    got = {(r.entity, r.term): round(r.disclosure, 9) for r in pii.disclosing(real(spark), pii.found_spans(real(spark))).collect()}
    assert got == {k: round(v, 9) for k, v in brute_disclosing(texts).items()}
    spans = {r.doc_id: r.spans for r in pii.op3(real(spark)).collect()}
    assert [spans[r.doc_id] for r in rows] == brute_spans(texts)
    masked = {r.doc_id: r.text for r in pii.stage(real(spark)).collect()}
    assert all(masked[r.doc_id] == r.text for r in rows if not spans[r.doc_id])
    for r in rows:
        if spans[r.doc_id]:
            assert masked[r.doc_id] == brute_mask(r.text, spans[r.doc_id])


def brute_mask(text, spans):
    out, at = [], 0
    for part in spans.split(","):
        name, s, e = part.split(":")
        s, e = int(s), int(e)
        if s >= at:
            word = text[s]
            out += [text[at:s], "" if name == "removed" else f"[{name.upper()}]" if name != "term" else "[NUMBER]" if word.isnumeric() else "[NAME]" if word.isupper() else "[TERM]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_pii_long_lists_and_texts(spark):
    """A list of addresses, a megabyte without a space, a megabyte of words around one number."""
    texts = [" ".join(f"mail w{k} a{k}@b.cd now" for k in range(3000)), "é" * 1_000_000 + "a@b.cd" + "x" * 1_000_000, "word " * 200_000 + "+1 555 010 9999" + " word" * 1000]
    masked = [r.text for r in sorted(pii.stage(docs_of(spark, texts)).collect(), key=lambda r: r.doc_id)]
    rows = {r.doc_id: r for r in pii.op3(docs_of(spark, texts)).collect()}
    assert rows[0].n_email == 3000 and rows[1].n_email == 1 and rows[2].n_phone == 1
    assert masked[1] == brute_mask(texts[1], rows[1].spans) and masked[2] == brute_mask(texts[2], rows[2].spans) and masked[0] == brute_mask(texts[0], rows[0].spans)


def brute_near(text):
    """(term, start) within six words on either side of each entity, looked for in the whole text."""
    term, base, out = re.compile(r"[^\W\d_][\w]+"), brute_base(text), set()
    for s, _, e, _, _ in base:
        around = [(m.start(), m.end(), m[0]) for m in term.finditer(text[:s])][-6:] + [(e + m.start(), e + m.end(), m[0]) for m in term.finditer(text[e:])][:6]
        out |= {(w.lower(), x) for x, y, w in around if not any(x < b[2] and b[0] < y for b in base)}
    return out


def test_pii_words_far_off_in_characters(spark):
    long = ["".join(random.Random(k).choices("abcdefgh", k=45)) for k in range(14)]
    texts = [
        "one two" + " " * 300 + "a@b.cd" + " . " * 200 + "three four",
        " ".join(long[:7]) + " a@b.cd " + " ".join(long[7:]),
        "漢" * 400 + " +1 555 010 9999 " + "字" * 400,
        "word4539 1488 0343 6467more x4539 1488 0343 6467é ab4539148803436467_cd",
        " ".join(f"w{k} a{k}@b.cd 1 2 3" for k in range(700)),
        "a@b.cd",
        *(t for t in HARD if t and brute_base(t)),
    ]
    got = {r.doc_id: {(w.term, w.start) for w in r.near} for r in pii.found_spans(docs_of(spark, texts)).collect()}
    assert got == {i: brute_near(t) for i, t in enumerate(texts)}
    assert len(got[1]) == 12 and {t for t, _ in got[0]} == {"one", "two", "three", "four"}


def test_pii_clashing_names(spark):
    docs = docs_of(spark, ["mail a@b.cd", "none"]).withColumnsRenamed({"key": "__d", "source": "__spans"}).withColumns({"__k": F.lit(1), "d": F.lit(2), "found": F.lit(3)})
    out = pii.stage(docs)
    assert out.columns == docs.columns and {r["__d"] for r in out.collect()} == {"clash"}


def test_pii_rows_and_columns(spark):
    docs = docs_of(spark, ["mail a@b.cd", "mail a@b.cd", "none", None, "ip 1.2.3.4"], [None, 1, 1, 2, 3])
    out = pii.stage(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) == sorted([(None, "mail [EMAIL]", 12), (1, "mail [EMAIL]", 12), (1, "none", 4), (2, None, 0), (3, "ip [IP]", 7)], key=str)
    assert pii.op3(docs).count() == 5 and pii.op3(docs.limit(0)).count() == 0
    plan = pii.op3(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


# -- tokens

EXTRA = ["", " ", "  ", "   x", "x   ", "a\nb\tc", "é漢🙂", "▁x", "x▁▁y", "　x", "\0", "a\0b \0", " " * 37 + "end" + " " * 16, "<s>[INST]", "http://x.y/z?q=1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890" * 5, "ﬁ ½ Ǆ", "the" * 3000, "ab" * 40_000]


@pytest.fixture(scope="module")
def tokenizer():
    import sentencepiece as library

    return library.SentencePieceProcessor(model_file=sentencepiece.MODEL)


def test_tokens_are_the_librarys(spark, tokenizer):
    r = random.Random(1)
    made = ["".join(r.choices("ab cd▁ eéx.,\n'the ing", k=r.randrange(60))) for _ in range(500)]
    for docs in (real(spark), docs_of(spark, EXTRA + made)):
        texts = dict(docs.select("doc_id", "text").collect())
        rows = sentencepiece.encode(docs).collect()
        assert len(rows) == len(texts)
        for row in rows:
            text = texts[row.doc_id]
            assert row.ids == tokenizer.encode(text), text[:80]
            assert row.n_tokens == len(row.ids)
            assert row.decoded == tokenizer.decode(row.ids) == text.replace("▁", " ")


def test_tokens_with_little_memory(tokenizer):
    codec = sentencepiece.Codec(sentencepiece.Vocabulary.read(sentencepiece.MODEL), indexed=50, remembered=4000)
    texts = [" ".join(f"word{i * j} é{i}" for j in range(30)) for i in range(40)]
    assert codec.encode_batch(texts) == tokenizer.encode(texts)


def test_tokens_of_long_words_in_windows(tokenizer):
    r = random.Random(3)
    codec = sentencepiece.Codec(sentencepiece.Vocabulary.read(sentencepiece.MODEL), indexed=50)
    codec.window = 61
    texts = ["".join(r.choices("abcdeingthrstoé漢", k=9000)) for _ in range(3)] + ["thethe" * 2000 + " the end", "x" * 20_000]
    assert codec.encode_batch(texts) == tokenizer.encode(texts)
    assert not any(len(w) > sentencepiece.LONG for w in codec.known)


def test_tokens_of_runs_of_spaces(tokenizer):
    """No piece has 15 marks."""
    codec = sentencepiece.Codec(sentencepiece.Vocabulary.read(sentencepiece.MODEL))
    texts = [t for n in range(1, 70) for t in (" " * n, " " * n + "x", " " * n + "漢", "a" + " " * n + "the", "a" + " " * n)]
    assert codec.encode_batch(texts) == tokenizer.encode(texts)
    for n in (300, 9000):
        assert codec.encode_batch(["a" + " " * n]) == [tokenizer.encode("a" + " " * n)]


def test_tokens_of_short_words_together(tokenizer, monkeypatch):
    """Neither a short word nor a pair of its pieces is looked at alone."""
    vocabulary = sentencepiece.Vocabulary.read(sentencepiece.MODEL)
    codec = sentencepiece.Codec(vocabulary)
    monkeypatch.setattr(sentencepiece.Vocabulary, "compatible", None)
    monkeypatch.setattr(codec, "_relax", None)
    r = random.Random(8)
    texts = ["".join(r.choices("ab é漢🙂\0\n,.theing", k=60)) for _ in range(800)]
    assert codec.encode_batch(texts) == tokenizer.encode(texts)


def test_tokens_pairs_that_share_a_place(monkeypatch):
    monkeypatch.setattr(sentencepiece, "PAIR_BITS", 6)
    vocabulary = sentencepiece.Vocabulary.read(sentencepiece.MODEL)
    pairs, r = sentencepiece.Pairs(vocabulary), random.Random(9)
    usable = [i for i, h in enumerate(vocabulary.halves) if h]
    left, right = np.array(r.choices([*usable, *vocabulary.ids.values(), -1], k=3000)), np.array(r.choices(usable, k=3000))
    left[left == vocabulary.ids["▁"]] = -1
    left[[not vocabulary.halves[i] and len(vocabulary.pieces[i]) > 1 for i in left]] = -1
    want = [vocabulary.compatible(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    assert 0 < sum(want) < 3000
    for _ in range(2):
        assert pairs.compatible(left, right).tolist() == want


def test_tokens_of_columns_in_slices(tokenizer, monkeypatch):
    monkeypatch.setattr(sentencepiece, "BATCH", 7)
    codec = sentencepiece.Codec(sentencepiece.Vocabulary.read(sentencepiece.MODEL))
    texts = ["cut off", None, "a  b the end of it ", "", "▁", None, "  c", "é漢 🙂 x" * 5, None]
    column = pa.array(texts)[1:]
    offsets, ids = codec.encode_array(column)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [tokenizer.encode(t or "") for t in texts[1:]]
    assert codec.decode_array(offsets, ids).to_pylist() == [(t or "").replace("▁", " ") for t in texts[1:]]
    half = np.array([codec.byte_ids[0xC3]], dtype=np.int32)
    assert codec.decode_array(np.array([0, 0, 1], dtype=np.int32), half).to_pylist() == ["", "\ufffd"]


def test_tokens_refuse_other_models(monkeypatch):
    """Unigram scores are no ranks."""
    import sentencepiece as library

    class Unigram(library.SentencePieceProcessor):
        def get_score(self, i):
            return -1.5

    monkeypatch.setattr(library, "SentencePieceProcessor", Unigram)
    with pytest.raises(ValueError):
        sentencepiece.Vocabulary.read(sentencepiece.MODEL)


def test_tokens_null_and_empty(spark):
    rows = {r.doc_id: r for r in sentencepiece.op4(docs_of(spark, [None, "", "a"])).collect()}
    assert rows[0].ids is None and rows[0].n_tokens is None and rows[0].decoded_sha256 is None
    assert rows[1].ids == [] and rows[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert sentencepiece.op4(docs_of(spark, ["a"]).limit(0)).count() == 0


# -- fingerprints


def brute_successors(rows):
    rows = sorted(((i is None, i, t or "") for i, t in rows), key=lambda x: (x[0], x[1] or 0, x[2]))
    out = []
    for k, (_, i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        one = lambda x: fingerprint.encode(*fingerprint.digests([x]))[0]
        a, b, c = one(t), one(edited), one(after)
        near = lambda x, y: float(fingerprint.likeness(*fingerprint.decode(x), *fingerprint.decode(y)))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(near(a, b), 9), round(near(a, c), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_fingerprints_brute_force(spark, ranges):
    rows = [(r.doc_id, r.text) for r in real(spark, 120).collect()] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(5000, "again"), (5000, "again"), (5000, "other"), (None, "null one"), (None, None)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, own string")
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprint.with_successors(docs, ranges).collect()), key=str)
    assert got == brute_successors(rows)


def test_fingerprints_of_long_texts_in_pieces(monkeypatch):
    text = "".join(random.Random(6).choices("abc é漢", k=5000))
    whole = fingerprint.bucket_counts([text.encode(), b"ab", b"", b"abc"])
    monkeypatch.setattr(fingerprint, "HELD", 100)
    assert (fingerprint.bucket_counts([text.encode(), b"ab", b"", b"abc"]) == whole).all() and whole[0].sum() == len(text.encode()) - 2


def test_fingerprints_tell_edits_from_strangers(spark):
    rows = fingerprint.op6(real(spark)).collect()
    long = [r for r in rows if r.n_chars > 400]
    edited, strange = np.array([r.near_edited for r in long]), np.array([r.near_next for r in long])
    assert np.median(edited) > np.median(strange) + 0.2
    assert (edited[:, None] > strange[None, :]).mean() > 0.9
    assert len(rows) == 1000


def test_fingerprints_few_rows(spark):
    one = docs_of(spark, ["only one"])
    (row,) = fingerprint.op6(one).collect()
    assert row.near_next == row.near_edited or row.near_next == 1.0
    assert fingerprint.op6(one.limit(0)).count() == 0


# -- packing


def valid(rows, lengths):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.length))
        bins[r.bin_id].append((r.bin_offset, r.length, r.capacity))
    assert Counter({i: sum(n for _, n in p) for i, p in pieces.items()}) == Counter(lengths)
    for p in pieces.values():
        assert sorted(k for k, _ in p) == list(range(len(p)))
    for b in bins.values():
        at = 0
        for offset, n, _ in sorted(b):
            assert offset == at
            at += n
        (capacity,) = {c for _, _, c in b}
        assert capacity == min(c for c in packing.LENGTHS if c >= at)
    return sum(b[0][2] for b in bins.values())


def brute_pack(lengths):
    """Best fit by looking through all the bins, with the same price of opening one."""
    cut = sorted(((min(8192, n - p * 8192), i, p) for i, n in lengths.items() for p in range(-(-n // 8192))), key=lambda x: (-x[0], x[1], x[2]))
    bins, out = [], {}
    for k, (n, i, p) in enumerate(cut):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            least = min(b[0] - b[1] for b in fits)
            b = max((b for b in fits if b[0] - b[1] == least), key=lambda b: b[3])
        else:
            rest = [m for m, _, _ in cut[k + 1 :]]
            price = lambda c: packing.cost(c) / (n + min(c - n, sum(m for m in rest if m <= c - n)))  # noqa: B023, E731
            b = [min((c for c in packing.LENGTHS if c >= n), key=lambda c: (price(c), c)), 0, len(bins), 0]
            bins.append(b)
        out[i, p] = (b[2], b[1])
        b[1] += n
        b[3] = k + 1
    return out


def test_packing_brute_force(spark):
    r = random.Random(2)
    lengths = {i: r.choice([1, 5, 40, 300, 511, 512, 513, 3000, 8192, 8193, 20000]) + r.randrange(50) for i in range(400)}
    rows = packing.pack(spark.createDataFrame(list(lengths.items()), "doc_id long, length long"), shards=1).collect()
    valid(rows, lengths)
    assert {(x.doc_id, x.piece): (x.bin_id, x.bin_offset) for x in rows} == brute_pack(lengths)


def test_packing_whole_table(spark):
    want = {x.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", x.text)) + 1 for x in real(spark).collect()}
    rows = packing.op9(real(spark)).withColumnRenamed("n_tokens", "length").collect()
    assert valid(rows, want) <= 1.05 * sum(want.values())


def test_packing_shards_and_odd_rows(spark):
    rows = packing.pack(spark.createDataFrame([(i % 50, 100 + i % 7) for i in range(500)] + [(None, 3), (None, 0)], "doc_id long, length long"), shards=5).collect()
    assert len(rows) == 502 and sum(x.length for x in rows if x.doc_id is None) == 4
    bins = defaultdict(int)
    for x in rows:
        bins[x.bin_id] += x.length
        assert x.bin_offset + x.length <= x.capacity
    assert packing.op9(docs_of(spark, TEXTS)).count() == len(TEXTS)
    assert packing.op9(docs_of(spark, TEXTS).limit(0)).count() == 0


def test_packing_holds_little_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_HELD", 40)
    big = (1 << 60) + 1
    rows = packing.pack(spark.createDataFrame([(None, 100)] * 300 + [(big, 9000)], "doc_id long, length long"), shards=2).collect()
    assert len(rows) == 302 and {x.doc_id for x in rows} == {None, big}
    bins = defaultdict(list)
    for x in rows:
        bins[x.bin_id].append((x.bin_offset, x.length, x.capacity))
    for pieces in bins.values():
        ends = [0, *(o + n for o, n, _ in sorted(pieces))]
        assert [o for o, _, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= pieces[0][2]
    named = packing.pack(spark.createDataFrame([("a", 5), ("b", 7)], "name string, length long"), key="name").collect()
    assert sorted((x.name, x.length) for x in named) == [("a", 5), ("b", 7)]


# -- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert len(rows) <= seen and len({r.doc_id for r in rows}) == len(rows), name
        docs, seen = spark.createDataFrame(rows, docs.schema), len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(whole) == sorted(packed)


def brute_quality(text):
    """(kept, cleaned) by the rules, line by line."""
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    every, good, lost = words(text), [], 0
    for line in text.split("\n"):
        n = len(words(line))
        bars = len(re.findall(quality.SEPARATOR, line))
        fails = n > 0 and (
            n < 4 and not re.search(quality.CLOSED, line) or 2 * len(re.findall(quality.SYMBOLS, line)) > n or 3 * line.count("!!") > n
            or 4 * bars >= max(n, 8) or n <= quality.BOILERPLATE_WORDS and bool(re.search(quality.BOILERPLATE, line))
        )
        lost += n if fails else 0
        good += [] if fails else [line]
    windows = [tuple(every[i : i + 8]) for i in range(len(every) - 7)]
    counts = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    base_failed = len(every) < 20 or 100 * len(repeated) > 30 * len(every)
    return not base_failed and not lost > 0.5 * len(every), "\n".join(good)


def test_pipeline_brute_force(spark):
    """All five stages over again in plain Python, each row and each pair looked at on its own."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    judged = [(r, brute_quality(r["text"] or "")) for r in rows]
    rows = [{**r, "text": cleaned, "n_chars": len(cleaned)} for r, (stays, cleaned) in judged if stays]
    left = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    encoders = langid.Encoders(langid.fit(left.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))
    rows = [{**r, "lang": lang} for r in rows for lang, _, rejected in [encoders.classify(r["text"])] if not rejected]
    component = brute_near_copies([(r["doc_id"], r["text"]) for r in rows])
    assert len(component) == len(rows)
    rows = [r for r in rows if component[r["doc_id"]] == r["doc_id"]]
    spans = brute_spans([r["text"] for r in rows])
    rows = [{**r, "text": brute_mask(r["text"], x) if x else r["text"]} for r, x in zip(rows, spans, strict=True)]
    assert any(spans) and len(rows) < docs.count()
    lengths = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) + 1 for r in rows}
    got = corpus_pipeline.run(spark, SMALL).withColumnRenamed("n_tokens", "length").collect()
    valid(got, lengths)
    assert {(r.doc_id, r.piece): (r.bin_id, r.bin_offset) for r in got} == brute_pack(lengths)

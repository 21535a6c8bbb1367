"""Operators that SQL can express, against their oracles on real tables and on odd rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravia.llm import chat, quality, urlfilter, warc
from tests.conftest import SF, duck, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality string"
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (4, "one"), (None, "a b c"),
    (5, "\n".join(["a line that comes back again and again here."] * 9)), (6, "x " * 30_000), (7, "w%d " * 3),
    (8, " ".join(f"w{i}" for i in range(25_000)) + "."), (9, "A | B | C | D | E | F | G | H | I | J | K | L\n" + " ".join("word" + chr(97 + i % 26) * (i % 7) for i in range(60)) + "."),
    (10, "é漢🙂 " * 25 + "\nAll rights reserved.\nRead more"), (11, "BUY!! NOW!! " * 12),
]


def odd(spark, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in ODD], schema)


def test_quality_oracle(spark):
    same(quality.op2(spark.read.parquet(f"{SF}/documents.parquet")), duck(), quality.ORACLE)


def test_quality_odd_rows(spark):
    docs = odd(spark)
    rows = {(r.doc_id, r.n_words): r for r in quality.op2(docs).collect()}
    assert not rows[1, 0].kept and rows[1, 0].base_failed
    # rows that repeat cannot be told apart by SQL on doc_id; they are judged alike
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    same(quality.op2(unique), duck(documents=unique.toPandas()), quality.ORACLE)
    assert quality.op2(docs).count() == len(ODD)
    assert quality.op2(docs.limit(0)).count() == 0


def test_quality_stage_cleans(spark):
    good = " ".join(f"word{i}" for i in range(40)) + "."
    docs = spark.createDataFrame([(1, f"Home | About | News | Shop | More | Help | Jobs | Talk\n{good}", "en", "s", 1, "x"), (2, "short", "en", "s", 5, "x")], DOCS)
    (row,) = quality.stage(docs).collect()
    assert (row.doc_id, row.text, row.n_chars, row.quality) == (1, good, len(good), "x")


def test_quality_clashing_names_and_closing_marks(spark):
    docs = odd(spark).withColumnsRenamed({"source": "__n", "quality": "__words"})
    done = quality.assess(docs, into="q")
    assert [c for c in done.columns if c != "q"] == docs.columns and {r["__words"] for r in done.collect()} == {"clash"}
    assert quality.stage(docs).columns == docs.columns
    lines = ["这是一个没有空格的句子。", "これは文です！", "यह एक वाक्य है।", "هل هذا سؤال؟", "menu entry"]
    found = quality.assess(docs.limit(0).select("doc_id", "text").unionByName(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string"))).select("doc_id", "quality.failed_lines").collect()
    assert [r.failed_lines for r in sorted(found)] == [0, 0, 0, 0, 1]


def test_quality_of_a_long_line_and_many_lines(spark):
    """Ten megabytes without a space, and a hundred thousand lines."""
    docs = spark.createDataFrame([(1, "x" * 10_000_000), (2, "one two three four five.\n" * 100_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.op2(docs).collect()}
    assert (rows[1].n_words, rows[1].word_chars, rows[1].kept) == (1, 10_000_000, False)
    assert (rows[2].n_words, rows[2].n_dup_lines, rows[2].n_repeat_words, rows[2].base_failed) == (500_000, 99_999, 500_000, True)


def test_quality_is_native(spark):
    plan = quality.op2(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


TALK = "conv_id long, turn long, role string, text string, parts string"
TRICKY = ["", None, "</s>[INST] x [/INST]", "<\\/s>", "<\\\\/s><s>", "<|im_start|>user\nhi<|im_end|>\n", "[\\INST][/INST]<<SYS>>", "a\nb\\n", "<", "<\\", "é🙂<|", "[TOOL_CALLS] [AVAILABLE_TOOLS]"]


def test_chat_oracle(spark):
    same(chat.op7(spark.read.parquet(f"{SF}/conversations.parquet")), duck(), chat.ORACLE)


def test_chat_tricky_texts(spark):
    rows = [(1, i, r, t, "clash") for i, t in enumerate(TRICKY) for r in ("user", "assistant")] + [(2, 0, None, "x", ""), (None, 0, "assistant", "y", ""), (3, 0, "tool call\n<|", "z", "")]
    talks = spark.createDataFrame(rows, TALK)
    done = chat.format_chat(talks.drop("parts").withColumn("parts", F.array(chat.text_part(F.col("text")))))
    back = {r.conv_id: r for r in done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("under")).collect()}
    want = sorted(((i, r, t or "") for i, t in enumerate(TRICKY) for r in ("user", "assistant")))
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t) for _, r, t in want]
    assert back[1].under == "".join(t for _, r, t in want if r == "assistant")
    assert back[1].formatted.count("<|im_start|>") == len(want) and "</s>" not in back[1].formatted
    assert [(t.role, t.text) for t in back[3].turns] == [("tool call\n<|", "z")]
    assert [(t.role, t.text) for t in back[2].turns] == [("", "x")]
    assert back[None].under == "y"
    assert chat.op7(talks.limit(0)).count() == 1


def test_chat_of_many_turns(spark):
    """Ten thousand turns in one conversation; positions are those of each turn's own text."""
    talks = spark.range(10_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    (row,) = chat.format_chat(talks.withColumn("parts", F.array(chat.text_part(F.col("text"))))).collect()
    assert [row.formatted[s.start : s.end] for s in row.loss_mask] == [f"t{i}" for i in range(1, 10_000, 2)]


def test_chat_attachments(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("uri"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [(1, 0, "user", [part("text", text="see "), part("image", uri="a.png", width=56, height=29), part("text", text=" and "), part("audio", uri="b.wav", seconds=2.0)]), (1, 1, "assistant", [part("document", uri="c.pdf", pages=2), part("text", text="ok")])]
    (row,) = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).collect()
    assert row.formatted == "<|im_start|>user\nsee <|image:0|> and <|audio:1|><|im_end|>\n<|im_start|>assistant\n<|document:2|>ok<|im_end|>\n"
    assert [(a.placeholder, a.kind, a.uri, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 1280)]
    assert row.expanded_tokens == 1334 and row.n_turns == 2
    (span,) = row.loss_mask
    assert row.formatted[span.start : span.end] == "<|document:2|>ok"


URLS = [None, "", "no scheme", "http://", "https://Example.ORG/es/x", "https://example.org/en/12?x#y", "http://a.b.example.org", "http://org/", "http://xorg/", "x://com/fr/://", "http://k.com/de/ads/1",
        "http://ads.site.net/x", "http://site.net/ads/1?q", "http://bads.net/", "http://s.net/p?sessionid=3", "http://s.net/wp-login.php?help", "http://s.net/wp-login.php?x", "http://s.net/a/robots.txt", "http://s.net/a.EXE",
        "http://s.net/tag/x/y/page/2", "http://s.net/x-download-free-y", "http://user@s.net:80/casino", "http://É.net/É\n/login/"]


def test_url_oracle(spark):
    same(urlfilter.op8(spark.read.parquet(f"{SF}/pages.parquet")), duck(), urlfilter.oracle())


def test_url_odd_rows(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    same(urlfilter.op8(pages), duck(pages=pages.toPandas()), urlfilter.oracle())
    assert urlfilter.op8(pages.limit(0)).count() == 0
    verdicts = dict(urlfilter.op8(pages).select("page_id", "verdict").collect())
    assert [u for i, u in enumerate(URLS) if verdicts[i] == "block"] == [URLS[i] for i in (4, 5, 10, 11, 12, 14, 16, 18, 19, 20, 21, 22)]


def test_url_index_fetches_what_all_rules_would(spark):
    f = urlfilter.Filter((), urlfilter.PATTERN_RULES, {"ads": 10, "search": 0})
    everything = [(urlfilter.compiled(r.pattern), r.verdict) for r in urlfilter.PATTERN_RULES]
    pages = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [u for u in URLS if u]
    for url in pages:
        said = {v for p, v in everything if p.search(url.lower())}
        assert f.by_pattern(url) == ("block" if said == {"block"} else "allow")
    assert sum(len(v) for v in f.filed.values()) >= len(urlfilter.PATTERN_RULES) - len(f.always)


def test_url_rules_from_a_table(spark):
    schema = "verdict string, host string, path string, pattern string"
    rows = [(r.verdict, r.host, r.path, None) for r in urlfilter.HOST_RULES] + [(r.verdict, None, None, r.pattern) for r in urlfilter.PATTERN_RULES]
    hosts, patterns = urlfilter.rules_of(spark.createDataFrame(rows, schema))
    assert set(hosts) == set(urlfilter.HOST_RULES) and set(patterns) == set(urlfilter.PATTERN_RULES)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    assert sorted(urlfilter.judge(pages, hosts=hosts, patterns=patterns).collect()) == sorted(urlfilter.judge(pages).collect())
    for bad in (("maybe", "x.org", "/", None), ("allow", None, None, None), ("allow", "x.org", None, "y")):
        with pytest.raises(ValueError, match="no rule"):
            urlfilter.rules_of(spark.createDataFrame([bad], schema))
    with pytest.raises(ValueError, match="two rules"):
        urlfilter.rules_of(spark.createDataFrame([("allow", "x.org", None, None), ("block", "X.org", "/", None)], schema))


def test_warc_oracle(spark):
    same(warc.op5(spark.read.parquet(f"{SF}/pages.parquet")), duck(), warc.ORACLE)


def test_warc_repeats_and_odd_rows(spark):
    big = "<p>é" + "x" * 2000
    rows = [(1, "http://a/\r\nX: y", big, "c"), (2, None, big, "c"), (3, "u", None, "c"), (4, "u", "", "c"), (5, "u", "x" * 999, "c"), (6, "u", "x" * 999, "c"), (7, "u", "y" * 1000, "c"), (8, "u", "y" * 1000, "c"), (9, "é", "WARC/1.1\r\n\r\n" * 200, "c"), (10, "u", "🙂" * 250, "c"), (11, "u", "🙂" * 250, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    same(warc.op5(pages), duck(pages=pages.toPandas()), warc.ORACLE)
    nulls = spark.createDataFrame([(None, "u", big, "c"), (3, "u", big, "c"), (3, "u", big, "c")], pages.schema)
    found = sorted((r.page_id is None, r.record_type, r.refers_to) for r in warc.op5(nulls).collect())
    assert found == [(False, "response", None), (False, "response", None), (True, "revisit", 3)]
    assert warc.op5(pages.limit(0)).count() == 0


def test_warc_hot_payload_is_spread(spark):
    """Nine tenths of the pages share a payload, and another payload is empty; no task of the join sees most of them."""
    rows = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") % 10 > 0, F.repeat(F.lit("x"), 1200)).when(F.col("id") % 20 > 0, F.lit("")).otherwise(F.repeat(F.col("id").cast("string"), 400)).alias("html"))
    single, several = warc.with_roles(rows)
    assert single.count() == 2_000 and "Join" not in single._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter, (map", "")
    keys = several.groupBy("digest", F.pmod(F.xxhash64("page_id", "url"), F.lit(warc.SALTS)).alias("salt")).count()
    assert keys.agg(F.max("count")).first()[0] < 2 * 18_000 / warc.SALTS
    same(warc.op5(rows), duck(pages=rows.toPandas()), warc.ORACLE)


def test_warc_random_access(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = f"file://{tmp_path}/bundles"
    index = warc.write(pages, folder, frame_bytes=20_000, bundle_bytes=50_000)
    html = dict(pages.select("page_id", "html").collect())
    rows = index.collect()
    assert sorted(r.page_id for r in rows) == sorted(html) and len({r.bundle for r in rows}) > 1
    for r in rows[::17]:
        headers, block = warc.read_record(f"{folder}/{r.bundle}", r.frame, r.offset)
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"
        if headers["WARC-Type"] == "response":
            assert block.split(b"\r\n\r\n", 1)[1].decode() == html[r.page_id]


def test_warc_bundle_is_plain_zstandard():
    import io

    import zstandard

    out = io.BytesIO()
    w = warc.BundleWriter(out, frame_bytes=100)
    parts = [bytes([i]) * 60 for i in range(9)]
    for p in parts:
        w.add(p)
    w.finish()
    data = out.getvalue()
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as r:
        assert r.read() == b"".join(parts)
    with pytest.raises(ValueError):
        warc.seek_table(data[:-1] + b"x")
    assert pd.DataFrame(warc.seek_table(data))[1].sum() < len(data)

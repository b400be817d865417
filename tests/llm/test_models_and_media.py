"""Toxicity, quality, audio, secrets, HTML, token counts and the pipeline."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hourgrid.llm import audio, html_main, quality, secrets, tokens, toxicity
from hourgrid.llm.common import budget_cut, within

from .test_pairs_and_lines import EDGE, brute_lines, brute_overlap, frame

WORDS = [f"word{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def crc(i):
    return zlib.crc32(str(i).encode()) % 5


# -- toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        text = prose(rng, rng.randint(20, 120)).split()
        for _ in range(rng.randint(3, 6) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "Wretch!", "SCOUNDREL,"]))
        rows.append((i, " ".join(text)))
        if i % 5 < 4:
            labels.append((i, int(bad) ^ int(rng.random() < 0.03)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(toxic):
    docs, labels = toxic
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(got) == 1500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id) == 0) for r in got)
    held = [(r.predicted, r.doc_id % 6 == 0) for r in got if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97


def test_toxicity_edge_rows(spark, toxic):
    docs, labels = toxic
    model = toxicity.fit_toxicity(frame(spark), labels.limit(0))
    got = toxicity.score_toxicity(frame(spark).withColumns({"score": F.lit("clash"), "b": F.lit(1)}), model).collect()
    assert len(got) == len(EDGE) and all(0 < r.score < 1 for r in got)
    assert toxicity.score_toxicity(frame(spark, []), toxicity.fit_toxicity(frame(spark, []), labels)).count() == 0


# -- quality


@pytest.fixture(scope="module")
def junk(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        text = prose(rng, rng.randint(10, 100))
        if i % 8 == 0:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(i % 8 != 0) ^ int(rng.random() < 0.03), 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_keeps_clean_documents(junk):
    docs, labels = junk
    got = quality.resample(docs, quality.fit_quality(docs, labels))
    assert set(docs.columns) < set(got.columns)
    rows = got.collect()
    assert not [r.doc_id for r in rows if r.selected and r.doc_id % 8 == 0]
    assert sum(r.selected for r in rows if r.doc_id % 8) / 1050 > 0.98


def test_gumbel_top_k_is_a_top_k(junk):
    docs, labels = junk
    model = quality.fit_quality(docs, labels)
    for k in (0, 1, 77, 1200, 5000):
        rows = quality.resample(docs, model, k=k).collect()
        best = {r.doc_id for r in sorted(rows, key=lambda r: -r.noisy_weight)[:k]}
        assert {r.doc_id for r in rows if r.selected} == best


def test_ngrams_stay_in_their_text():
    b, owner = quality.ngram_buckets(np.array([1, 2, 3, 7], np.int32), np.array([0, 3, 3, 4]), 10_000)
    assert sorted(owner.tolist()) == [0, 0, 0, 0, 0, 2]
    assert sorted(b[owner == 0].tolist()) == sorted([1, 2, 3, (1 * 1_000_003 + 2) % 10_000, (2 * 1_000_003 + 3) % 10_000])


def test_quality_edge_rows(spark, junk):
    df = frame(spark).withColumns({"selected": F.lit("clash"), "raw": F.lit(1), "__x": F.lit(1)})
    got = quality.resample(df, quality.fit_quality(df, junk[1].limit(0)))
    assert got.count() == len(EDGE) and got.filter("selected is null").count() == 0
    assert quality.resample(frame(spark, []), quality.fit_quality(frame(spark, []), junk[1])).count() == 0


def test_budget_cut_against_a_sort(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.gauss(0, 0.02), f"{i:04d}", rng.randint(0, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k double, t string, n long")
    budgets = {"a": 700.0, "b": 0.0}
    cut = budget_cut(df, "g", "k", "t", "n", spark.createDataFrame(list(budgets.items()), "g string, b double"), "b")
    got = {r.t for r in df.join(cut, F.col("g") == F.col("__g"), "left").filter(within(F.col("k"), F.col("t"))).collect() if r.n}
    want = set()
    for g, b in budgets.items():
        upto = 0
        for _, _, t, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            if upto + n / 2 <= b and n:
                want.add(t)
            upto += n
    assert got == want


# -- audio


def slow_mu(b):
    b = ~b & 255
    v = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return -v if b & 128 else v


def slow_ima(block):
    value, index = struct.unpack("<hB", block[:3])
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[code & 7])))
            out.append(value)
    return out


def test_codecs():
    mu, a = audio.mu_law_table(), audio.a_law_table()
    assert [slow_mu(b) for b in range(256)] == [int(v) for v in mu]
    assert len(set(a.tolist())) == 256 and a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    raw = random.Random(4).randbytes(36 * 7 + 20)
    want = [s for i in range(0, len(raw), 36) for s in slow_ima(raw[i : i + 36])]
    got = audio.decode_ima([raw, b"", raw[:36], raw[:3], raw[36:41]], 36)
    assert [x.tolist() for x in got] == [want, [], want[:65], [], want[65:68]]
    # Two channels: headers, then four bytes of each in turn.
    left, right = raw[:36], raw[36:72]
    both = left[:4] + right[:4] + b"".join(left[i : i + 4] + right[i : i + 4] for i in range(4, 36, 4))
    mean = [int((a + b) / 2) for a, b in zip(slow_ima(left), slow_ima(right), strict=True)]
    assert [x.tolist() for x in audio.decode_ima([both * 2, both[:16]], 72, 2)] == [mean * 2, mean[:9]]
    pcm = (8000 * np.sin(np.arange(800) / 20)).astype(np.int16)
    up = audio.resample(pcm, 8000, 16000)
    assert len(up) == 1600 and np.abs(up[40:-40:2].astype(int) - pcm[20:-20].astype(int)).max() < 200


def test_texts_survive_as_audio(spark):
    rows = EDGE + [(9, "é\U0001f600" * 500, "x", "y", 1), (10, "a" * 192, None, None, 0)]
    clash = frame(spark, rows).withColumns({"media": F.lit(1), "pcm": F.lit(2), "feature": F.lit(3), "codec": F.lit(4)})
    codecs = [None, *audio.CODECS]
    got = None
    for c in codecs:
        part = audio.decode_media(audio.encode_texts(clash, codec=F.lit(c)))
        got = part if got is None else got.unionByName(part)
    assert "pcm" not in got.columns and {r.codec for r in got.collect()} == set(audio.CODECS)
    found = sorted(((r.doc_id or 0), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got.collect())
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.append((i or 0, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert found == sorted(want * len(codecs))
    assert audio.decode_media(audio.encode_texts(frame(spark, []))).count() == 0


def test_broken_and_other_files(spark):
    wav = [audio.wav_bytes(b"\x00\x7f\xff\x80", audio.A_LAW, 8000), audio.wav_bytes(struct.pack("<4h", 1, -2, 3, -4), audio.PCM, 16000, 16, 2), audio.wav_bytes(b"", audio.MU_LAW, 8000), b"RIFFxxxxWAVEfmt ", b"", None, audio.wav_bytes(b"\0\0\0\0" + b"\x11" * 32, audio.IMA_ADPCM, 8000, 4, 36)]
    df = spark.createDataFrame([(i, bytearray(w) if w is not None else None) for i, w in enumerate(wav)], "i int, media binary")
    got = {r.i: r for r in audio.decode_media(df, pcm=True).collect()}
    assert all(r.pcm is None or r.pcm_sha256 == hashlib.sha256(r.pcm).hexdigest() for r in got.values())
    assert [got[i].error is None for i in range(7)] == [True, True, True, False, False, False, True]
    assert np.frombuffer(got[1].pcm, "<i2").tolist() == [1, -2, 3, -4] and got[2].pcm == b"" and len(got[6].pcm) == 65 * 2 * 2


def test_audio_query_against_brute_force(spark, tmp_path):
    from hourgrid.llm.queries import op4_telephony_audio

    rng = random.Random(9)
    rows = EDGE + [(i, "é" * 3000 + prose(rng, rng.choice([1, 30, 400])), "x", "y", 1) for i in range(20, 60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    tables = {"mu_law": audio.mu_law_table(), "a_law": audio.a_law_table()}
    got = op4_telephony_audio(spark, str(tmp_path)).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id or 0, []).append((r.codec, r.payload_sha256, r.feature, r.pcm_bytes, r.pcm_sha256))
    want = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        codec = list(audio.CODECS)[zlib.crc32(raw) % 3]
        pcm = [int(tables[codec][b]) for b in full] if codec in tables else [s for k in range(0, len(full), 192) for s in slow_ima(full[k : k + 192])]
        wide = audio.resample(np.array(pcm, np.int16), 8000, 16000).astype("<i2").tobytes()
        crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        feature = f"samples={len(pcm)};mean={np.mean(pcm):.3f};rms={np.sqrt(np.mean(np.square(np.array(pcm, float)))):.3f};peak={np.abs(pcm).max():.0f};crossings={crossings};pcm={zlib.crc32(wide):08x}"
        want.setdefault(i or 0, []).append((codec, hashlib.sha256(full).hexdigest(), feature, len(wide), hashlib.sha256(wide).hexdigest()))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    assert {r.codec for r in got} == set(audio.CODECS)


# -- secrets


def test_false_positives_go(spark):
    rng = random.Random(5)
    rows = []
    for i in range(500):
        real = i % 2 == 0
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40)) if real else rng.choice(["release-2024-notes", "1234567890123456", "section12chapter"]) + str(i)
        rows.append((i, f"some words here {'token = ' if real else 'see '}\"{value}\" more words here section chapter", f"dir/s{i % 3}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, 0, int(i % 2 == 0)) for i in range(500)], "doc_id long, pos int, label int")
    got = secrets.scan_secrets(docs, labels).collect()
    assert len(got) == 500
    held = [(r.is_secret, r.doc_id % 2 == 0) for r in got if crc(r.doc_id) == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.98


def test_candidates(spark):
    text = "x token='abc123abc123' " + "a" * 5000 + " and " + "b" * 3000 + "1 done short1"
    got = secrets.candidates(spark.createDataFrame([(1, text, None), (2, None, "p"), (3, "", "p")], "doc_id long, text string, source string")).orderBy("pos").collect()
    assert [(r.doc_id, r.pos, len(r.candidate), r.before, r.after[:4]) for r in got] == [(1, 0, 12, "token", "aaaa"), (1, 1, 3001, "and", "done")]
    none = secrets.scan_secrets(frame(spark).withColumns({"pos": F.lit(1), "label": F.lit("clash")}))
    assert none.count() == 0 and none.columns[-1] == "is_secret"


# -- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>menu item</a></ul></nav><div class="ad">buy</div><div class="cookie-notice">we use cookies</div>
<article class="post post-%d"><h1>Head &amp; more</h1><p><b>First  para
of text<br>on &lt;two&gt; lines, %s<p>Second &eacute; para, long enough to count as prose.</p><aside>side</aside><form><p>mail</p></form>
<!-- gone --><ul><li>one<li>two</ul></article><div class="comments"><p>reader says a lot of things here</p></div><footer>&copy; x</footer></body></html>"""
TEXT = "Head & more\nFirst para of text on <two> lines, %s\nSecond é para, long enough to count as prose.\none\ntwo"


def test_main_text_by_consensus(spark):
    pages = [(i, f"https://h{i % 2}.example/x{i}?q", PAGE % (i, f"no {i}")) for i in range(6)]
    pages += [(50, "https://h0.example/odd", "<body><div class=x><p>only this text</p></div><div class=side-menu>m</div></body>"), (51, None, None), (52, "", ""), (53, "no url", "plain &amp text <3"), (50, "https://h0.example/odd", "<p>un<p>closed")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"text": F.lit(1), "path": F.lit(2), "vote": F.lit(3)})
    got = html_main.extract_main_text(df)
    rows = {(r.page_id, len(r.html or "")): r for r in got.collect()}
    assert len(rows) == len(pages)
    for (i, _), r in rows.items():
        want = TEXT % f"no {i}" if i < 6 else {51: "", 52: "", 53: "plain & text <3"}.get(i, "only this text" if r.html and "only" in r.html else "un\nclosed")
        assert r.text == want and r.n_chars == len(want)
    assert {r.path for (i, _), r in rows.items() if i < 6} == {"html>body>article.post.post-#"}
    assert html_main.extract_main_text(df.limit(0)).count() == 0


def test_sections_of_an_article_stay_together():
    page = "<body><main><article><section><p>%s</p></section><section><p>short end</p></section></article><div>x</div></main></body>" % ("long text " * 50)
    assert html_main.main_text(html_main.parse(page)).endswith("\nshort end")


def test_words_in_attributes():
    page = "<body><article class='post comments-open' title='a hidden id'><p data-x=\"role class hidden\">kept</p><div class=has-sidebar>kept too</div><div hidden>no</div><div id=cookie_notice>no</div></article></body>"
    assert html_main.main_text(html_main.parse(page)) == "kept\nkept too"


# -- token counts


@pytest.fixture(scope="module")
def coder():
    return tokens._counts(open(tokens.RANKS, "rb").read(), tokens.PATTERN, tokens.SAFE)


#: Characters that meet in every order: letters, digits, signs, contractions, white space of many kinds.
MEETING = "abst'1\u0662.!\u2014 \n\t\u3000\u00a0\x1c\u00e9\u4e2d\u0301\U0001f600"


def mixed(rng, n):
    return "".join(rng.choice(MEETING) for _ in range(n))


def check_tree(root):
    """Sums of every node, one height of all leaves, and what is stored comes back."""
    def height(node):
        if not node.kids:
            return 0
        assert node.chars == sum(k.chars for k in node.kids) and node.tokens == sum(k.tokens for k in node.kids) and len(node.kids) <= 2 * tokens.FAN_OUT
        heights = {height(k) for k in node.kids}
        assert len(heights) == 1
        return heights.pop() + 1

    height(root)
    text, stored = "".join(tokens.pieces(root, 0, root.chars)), tokens.store(root)
    assert tokens.store(tokens.restore(text, *stored)) == stored
    return text


def test_leaves_add_up(coder):
    rng = random.Random(6)
    for text in ["", " ", "a", "  two  spaces\n\n x", "it's we'll 12345 abc… 　ÀÉ", prose(rng, 900), "x" * 3000, "\x1c a b" * 200, "line\n" * 900, "漢字、かな。" * 400, *[mixed(rng, 400) for _ in range(100)]]:
        for size in (1, tokens.LEAF_CHARS):
            made = tokens.leaves(text, coder, size)
            assert "".join(x.text for x in made) == text and sum(x.tokens for x in made) == coder.of(text) == len(coder.coder.encode_ordinary(text))
    assert len(tokens.leaves("line\n" * 900, coder)) > 15 and len(tokens.leaves("漢字、かな。" * 400, coder)) > 8


def test_edits_equal_a_new_count(coder):
    rng = random.Random(7)
    for turn in range(300):
        own = mixed if turn % 2 else prose
        size = rng.choice([1, 4, tokens.LEAF_CHARS])
        text = own(rng, rng.choice([0, 3, 60, 600, 4000 if size > 4 else 60]))
        root = tokens.grow(tokens.leaves(text, coder, size))
        for _ in range(3):  # edits of edited trees
            edits, at = [], 0
            while at <= len(text) and rng.random() < 0.8:
                s = rng.randint(at, len(text) + 2)
                n = rng.choice([0, 0, 1, 5, 300, 5000])
                edits.append((s, n, rng.choice(["", " ", "x", "'", "s", "1", " new words", "\n\n", "  ", "word " * 300, mixed(rng, 5)])))
                at = s + n
            root, again = tokens.edit(root, edits, coder, size)
            want = text
            for s, n, x in reversed(edits):
                s = min(s, len(text))
                want = want[:s] + x + want[min(s + n, len(text)) :]
            assert check_tree(root) == want and root.tokens == len(coder.coder.encode_ordinary(want))
            if len(text) > 20_000 and edits and all(n < 10 and len(x) < 20 for _, n, x in edits):
                assert again < len(text) / 2
            text = want


def test_an_edit_renews_one_path(coder):
    root = tokens.grow(tokens.leaves("one line\n" * 40_000, coder))
    before = {id(x) for x in root.kids}
    new, again = tokens.edit(root, [(180_000, 3, "another\nnew line")], coder)
    assert again < 2000 and sum(id(x) not in before for x in new.kids) <= 2


def test_token_columns(spark, coder):
    df = frame(spark).withColumns({"tree": F.lit("clash"), "n_before": F.lit(1)})
    df = df.withColumn("edits", F.when(F.col("doc_id") != 4, F.expr("array(struct(0 as start, 2 as length, 'Begin ' as text))")))
    got = tokens.apply_edits(tokens.build_trees(df)).collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert r.n_tokens == len(coder.coder.encode_ordinary(r.text))
    assert {r.n_encoded for r in got if r.doc_id == 4} == {0} and {r.text for r in got if r.doc_id == 1} == {"Begin "}
    assert tokens.build_trees(frame(spark, [])).count() == 0


# -- pipeline


def test_stages_against_brute_force(spark, junk, tmp_path):
    docs, labels = junk
    rng = random.Random(8)
    item = prose(rng, 30)
    rows = [tuple(r) for r in docs.collect()]
    rows += [(2000 + i, f"Common line of all\n{prose(rng, 40)}", "en", "s1", 0) for i in range(30)]
    rows += [(3000 + i, rows[1][1], "en", "s2", 0) for i in range(5)] + [(4000, prose(rng, 30) + " " + item, "en", "s0", 0)]
    folder = str(tmp_path / "in")
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels.union(spark.createDataFrame([(i, 1, 0) for i in [*range(2000, 2030), *range(3000, 3005), 4000]], labels.schema)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, folder)
        if i < 4:
            assert out.columns == table.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        table = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept.append({r["doc_id"]: r for r in pq.read_table(str(tmp_path / f"stage{i}")).to_pylist()})
    clean = {r[0]: r[1] for r in rows if r[0] >= 2000 or r[0] % 8}
    assert set(kept[0]) <= set(clean) and len(kept[0]) > 0.97 * len(clean)
    for i, _, _, text in brute_lines([(i, r["text"]) for i, r in kept[0].items()]):
        assert kept[1][i]["text"] == text and kept[1][i]["n_chars"] == len(text)
    same = {rows[1][0], *range(3000, 3005)}
    assert len(same & set(kept[1])) > 1 and same & set(kept[2]) == {min(same & set(kept[1]))}
    hit = {i for i, _, n, _ in brute_overlap([(i, r["text"]) for i, r in kept[2].items()], [(1, item)]) if n}
    assert set(kept[3]) == set(kept[2]) - hit and 4000 in hit
    assert set(kept[4]) == set(kept[3]) and sum(r["taken"] for r in kept[4].values()) == pytest.approx(1.5 * sum(r["size"] for r in kept[4].values()), rel=0.05)
    assert corpus_pipeline.run(spark, folder).count() == len(kept[4])

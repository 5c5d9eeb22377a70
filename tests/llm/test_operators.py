"""Each corpus operator against a brute-force version, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, html_extract, mixing, pii, quality_prior, quality_rules, quoting, simhash, token_output, toxicity

ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "two words", "en", "b", 9), (4, " \t\n ", "en", "b", 4),
    (5, "the cat sat on the mat and the dog sat on the mat " * 30, "en", "a", 1500), (6, "x" * 5000, "en", "a", 5000), (7, "mail a.b@c.org and 10.0.0.1 or +1 (555) 123-4567", "en", "a", 50),
]


@pytest.fixture(scope="module")
def odd(spark):
    # An extra column whose name an operator uses inside.
    return spark.createDataFrame([(*r, "kept") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, component_id string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_simhash_against_all_pairs(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([2, 40, 300]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.linked(df).collect()}
    fps = np.array([simhash.simhash(t) for t in texts], dtype=np.uint64)
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert got == {i: (f"{int(f):016x}", label[i]) for i, f in enumerate(fps)}


def test_simhash_large_bucket_by_masks():
    r = np.random.default_rng(1)
    f = np.unique(r.integers(0, 1 << 14, 3000).astype(np.uint64))
    assert (simhash._roots_by_masks(f) == simhash._merge(np.arange(len(f)), *np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2, 1)))).all()


def test_chain_budgets_hold_for_every_close_pair():
    r = np.random.default_rng(2)
    x = np.zeros(5000, dtype=np.uint64)
    for k in range(2):
        x ^= np.uint64(1) << r.integers(0, 64, 5000).astype(np.uint64)
    assert simhash.chains_within(x).all() and not simhash.chains_within(np.array([(1 << 64) - 1], dtype=np.uint64)).any()


def test_simhash_odd_rows(odd, empty):
    got = simhash.linked(odd).collect()
    zero = [x for x in got if x.fingerprint == "0" * 16]
    assert len(got) == len(ODD) and len(zero) == 3 and {x.component_id for x in zero} == {1}
    assert simhash.linked(empty).count() == 0


def test_token_files(spark, odd, empty, tmp_path):
    path = str(tmp_path / "tokens")
    got = {(x.doc_id, x.start): (x.n_tokens, x.ids_crc32) for x in token_output.encoded(odd, path=path).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_output.tokenizer_file())
    start, want = 0, {}
    for doc_id, text, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[doc_id, start] = (len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    assert [x.doc_id for x in token_output.read_tokens(spark, path, 5, 6).select("doc_id").orderBy("doc_id").collect()] == [5, 6]
    assert token_output.read_metadata(spark, path).columns == ["ord", "doc_id", "n_tokens"]
    files = sorted((tmp_path / "tokens" / "data").glob("*.parquet"))
    column = {c["path_in_schema"].split(".")[0]: c for c in (pq.ParquetFile(files[-1]).metadata.row_group(0).column(i).to_dict() for i in range(4))}
    assert "DELTA_BINARY_PACKED" in column["doc_id"]["encodings"] and "RLE_DICTIONARY" in column["tokens"]["encodings"]
    assert pq.ParquetFile(files[-1]).metadata.row_group(0).column(1).has_column_index
    assert token_output.encoded(empty).count() == 0


def test_encoder_equals_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_output.tokenizer_file())
    monkeypatch.setattr(token_output, "CACHED_CHARS", 3000)
    e = token_output.Encoder(token_output.tokenizer_file())
    signs = ["a", "b", " ", " ", "\n", "é", "1", "²", ".", "'s", "'ll", "’", "ß", "_", "½", "ª", "中", "😀", "—", "\0", "!", "\t", "<|endoftext|>", "\xa0", "\u3000", "\x1c", "\x85"]
    r = random.Random(3)
    for k in range(1500):
        texts = ["".join(r.choice(signs if k % 2 else signs[:21]) for _ in range(r.randint(0, 25))) for _ in range(5)] + [None]
        ids, counts = e.encode(pa.array(texts, pa.string()), 7)
        at = 0
        for t, n in zip(texts, counts, strict=True):
            assert ids[at : at + n].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 7], t
            at += n
        assert at == len(ids)


def test_token_files_of_special_and_long_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_output.tokenizer_file())
    texts = ["a <|endoftext|> b", "word " * 200_000, "x" * 300_000, "tab\tand  two spaces", "中文 text", None]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ord int")
    got = token_output.encoded(df, path=str(tmp_path / "t")).orderBy("doc_id").collect()
    start = 0
    for t, x in zip(texts, got, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


_PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, p in enumerate(_PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
            luhn = sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns():
    r = random.Random(1)
    for _ in range(20000):
        text = "".join(r.choice("01259 .-+()@ab%_") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_in_linear_time():
    for text in ("9" * 300_000, "a" * 300_000 + "@", "1." * 200_000, "+1(" * 100_000):
        pii.base_spans(text)


def test_skip_chain_adds_repeats_and_leaves_decoys(spark):
    shared = [f"call +1 (988) 555-{i:04d} now" for i in range(1000, 1060)] + [f"card {9807915762804490 + i}" for i in range(0)]
    texts = [*shared, "call +1 (988) 555-2485 now, or 988 555-2485 later", "mail bob.42@mail.example.com, bob.42 said", "9807915762804490 and 9807915762804490", "in 2021 order 12345678"]
    got = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    by = {x.doc_id: x for x in got}
    assert "phone:31:43" in by[60].spans and by[60].n_phone == 1 and by[61].spans.startswith("email:5:28,email:30:36")
    assert by[62].spans == "" == by[63].spans
    base = pii._said(plain_spans(texts[60]))
    assert by[60].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_pii_odd_rows(odd, empty):
    got = pii.spans(odd).collect()
    assert len(got) == len(ODD) and {(x.n_email, x.n_ip, x.n_phone) for x in got if x.doc_id == 7} == {(1, 1, 1)}
    assert pii.spans(empty).count() == 0
    assert "<email>" in pii.redacted(odd).where("doc_id = 7").first().text and pii.redacted(odd).count() == len(ODD)


def toxic_rows(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        text = [r.choice("river stone light green water table".split()) for _ in range(30)]
        # Group names are as frequent in toxic texts as the insult itself.
        text += ["gay"] * (i % 8 == 0) + ["idiot"] * bad
        rows.append((i, " ".join(text), int(bad)))
    return spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")


def test_toxicity_learns_words_not_groups(spark):
    docs, labels = toxic_rows(spark)
    model = toxicity.train(docs, labels)
    score = model.scorer()
    assert score("you idiot") > 0.5 > score("river stone")
    assert abs(score("river gay stone") - score("river straight stone")) < 0.02
    out = toxicity.scored(docs, model).join(labels, "doc_id")
    assert out.where("held_out AND predicted <> toxic").count() == 0
    held = {x.doc_id for x in out.where("held_out").collect()}
    assert held == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.scored(odd, model).where("score BETWEEN 0 AND 1").count() == len(ODD) and toxicity.scored(empty, model).count() == 0


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, odd, empty):
    r = random.Random(4)
    texts = ["".join(r.choice(["a ", "b ", "c\n", "#", "é ", "\t", "dd "]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_rules.verdicts(quality_rules.ledger(df)).orderBy("doc_id").collect()
    for t, x in zip(texts, got, strict=True):
        m = plain_measures(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == m
        assert x.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (x.kept and x.base_failed)
    rows = quality_rules.ledger(odd)
    assert rows.count() == len(ODD) and quality_rules.ledger(empty).count() == 0
    only = {(x.version, x.rule): (x.n_failed, x.n_only) for x in quality_rules.ablations(rows).collect()}
    bits = [x.fail_bits for x in rows.collect()]
    for v, m in quality_rules.POLICIES.items():
        for name, i in quality_rules.BITS.items():
            if m >> i & 1:
                assert only[v, name] == (sum(b >> i & 1 for b in bits), sum(b & m == 1 << i for b in bits))


TALK = [
    (1, 0, "user", "Hello there, I have a question.\nHow do I sort a list?"), (1, 1, "assistant", "> How do I sort a list?\nUse sorted().\n\nIt returns a new list for you."),
    (1, 2, "user", ">> how do i sort a list\n> Use sorted().\n> It returns a new list for you.\n>\nThanks a lot to you!"), (1, 3, "assistant", "> Thanks a lot to you!\nYou are welcome."),
    (1, 4, "user", "> Hello there, I have a question.\nDid you see that one?"), (1, 5, "user", "> not said anywhere at all\nok"), (1, 6, "user", "Yes."),
    (1, 7, "assistant", "> Yes\nFirst point.\nSecond point.\n> Ok\nThird point.\n\nFourth."), (1, 8, "user", ">Second point.\n> Third point.\nThat is two lines of it.\n> First point.\n> Third point.\nnot in a row"), (1, 9, "user", "> !!!\n> ..."), (2, 0, "user", None), (2, None, "user", "> x"), (None, 1, None, "a > b"), (None, 1, None, "a > b"),
]


def test_quotations(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.position): x for x in quoting.conversations(df).collect()}
    assert len(got) == len(TALK)
    assert [(got[1, i].n_quotes, got[1, i].n_linked, got[1, i].reply_to) for i in range(10)] == [(0, 0, None), (1, 1, 0), (2, 2, 1), (1, 1, 2), (1, 1, 0), (1, 0, 4), (0, 0, 5), (2, 2, 6), (2, 1, 7), (1, 0, 8)]
    assert got[1, 2].text == "Thanks a lot to you!" and got[2, 1].text == "" and got[None, 1].text == "a > b"
    assert quoting.conversations(df.limit(0)).count() == 0
    import duckdb

    c = duckdb.connect()
    c.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in TALK if r[0] is not None]))
    names = [x[0] for x in c.sql(quoting.OP6_SQL).description]
    assert sorted(map(repr, c.sql(quoting.OP6_SQL).fetchall())) == sorted(repr(tuple(x[n] for n in names)) for k, x in got.items() if k[0] is not None)


def test_quotations_of_generated_threads(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(quoting, "PART", 4)
    r = random.Random(6)
    pool = ["Yes.", "Thanks a lot!", "See you", "that is right", "no, wait", "Überall 3", "ok", "-- "]
    rows = []
    for c in range(25):
        said = []
        for t in range(r.randint(1, 14)):
            lines = [" ".join(r.choice(pool) for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 4))]
            if said and r.random() < 0.7:
                old = r.choice(said).split("\n")
                a = r.randrange(len(old))
                quoted = [">" * r.randint(1, 2) + " " + x for x in old[a : a + r.randint(1, 3)]]
                at = r.randint(0, len(lines))
                lines[at:at] = [x.upper() if r.random() < 0.2 else x for x in quoted]
            said.append("\n".join(lines))
            rows.append((c, r.choice([t, t, t // 2]), r.choice(["user", None]), said[-1]))
    got = quoting.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    c = duckdb.connect()
    c.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), x, strict=True)) for x in rows]))
    said = c.sql(quoting.OP6_SQL)
    got = [tuple(x[n] for n in said.columns) for x in got.collect()]
    want = said.fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    linked = said.columns.index("n_linked")
    assert sum(x[linked] for x in want) > 30


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    t = mixing.targets({"a": 1, "b": 100, "c": 100})
    assert t["a"] == 3 and abs(sum(t.values()) - 201) < 1e-9 and t["b"] == 2 * t["c"]
    assert mixing.targets({}) == {}


def test_mixing(spark, odd, empty):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randint(0, 300)), r.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df).collect()
    source = {i: s for i, _, s in rows}
    taken, size = Counter(), Counter()
    for x in got:
        taken[source[x.doc_id]] += x.taken
        size[source[x.doc_id]] += x.size
        assert x.taken <= 3 * x.size and x.size == len(rows[x.doc_id][1].split())
    want = mixing.targets(dict(size))
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(df).collect()))
    per = {x.doc_id: x.taken for x in got if x.taken}
    mix = mixing.mixture(df).groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {x.doc_id: x.n for x in mix} == per
    assert mixing.mixed(odd).count() == len(ODD) and mixing.mixed(empty).count() == 0
    assert mixing.mixture(odd).columns == odd.columns and mixing.mixture(empty).count() == 0


LONG = "This is the long main paragraph of the article and it goes on for more than a few words in the text."
PAGES = [
    ("<title>t</title><nav><a href=x>Home</a></nav><article><h1>T&eacute;st</h1><p>" + LONG + "</p><aside>See also</aside><p>Ok.</p></article><footer>(c)</footer>", "Tést\n" + LONG + "\nOk."),
    ('<div id="content"><h1>Title</h1><p>' + LONG + "</p><p>Short.</p><p>" + LONG + '</p></div><div id="sidebar"><p>' + LONG + "</p></div>", "Title\n" + LONG + "\nShort.\n" + LONG),
    ("<article><p>a<br>b</p><ul><li>one<li>two</ul><form>f</form><p>z&nbsp;&lt;b&gt; &#x41;<script>if(a<b){'</p>'}</script></article>", "a b\none\ntwo\nz <b> A"),
    ('<article><header><h1>Head</h1></header><p>x</p><div class="comments"><p>' + LONG + "</p></div><!-- c --></article>", "Head\nx"),
    ("", ""), (None, ""), ("<p", ""), ("<article>unclosed <b>bold <p>para", "unclosed bold\npara"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = html_extract.extracted(df).orderBy("page_id").collect()
    assert [x.text for x in got] == [t for _, t in PAGES] and [x.n_chars for x in got] == [len(t) for _, t in PAGES]
    assert html_extract.extracted(df.limit(0)).count() == 0


def test_quality_prior(spark, odd, empty):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        host, bad = ("bad.org", r.random() < 0.8) if i % 3 == 0 else ("good.org", r.random() < 0.05)
        words = [f"word{r.randint(0, 5000)}" for _ in range(80)]
        rows.append((i, " ".join(w + "###" if bad else w for w in words), "en", host))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    label = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_prior.scored(docs, label).join(label, "doc_id").collect()
    assert all(x.kept == bool(x.quality) for x in got)
    prior = {rows[x.doc_id][3]: x.site_prior for x in got}
    assert prior["bad.org"] < 0.4 < 0.8 < prior["good.org"]
    kept = quality_prior.accepted(docs, label)
    assert kept.columns == docs.columns and kept.count() == sum(x.kept for x in got)
    none = label.limit(0)
    assert quality_prior.accepted(odd, none).count() == len(ODD) and quality_prior.accepted(odd, label).columns == odd.columns and quality_prior.scored(empty, label).count() == 0


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_against_edit_distance():
    r = random.Random(5)
    pool = "the of and rein thing tion anes ouer blend she hath ing stone edge".split()
    text = lambda n: " ".join(r.choice(pool) + r.choice(["", "s", "ed"]) for _ in range(n))
    for _ in range(25):
        items = [(i, text(r.randint(6, 14))) for i in range(3)]
        docs = []
        for _ in range(4):
            leak = list(r.choice(items)[1])
            for _ in range(r.randint(0, len(leak) // 8)):
                p = r.randrange(len(leak))
                leak[p : p + r.randint(0, 1)] = r.choice(["", "x", " "])
            docs.append(text(r.randint(3, 20)) + " " + "".join(leak) + " " + text(3))
        got = {(n, i): k for n, i, _, _, k in decontaminate.matches(docs, decontaminate.Index(items))}
        for n, d in enumerate(docs):
            for i, (_, t) in enumerate(items):
                item = decontaminate.normal(t)
                k = edits(item, decontaminate.normal(d))
                assert got.get((n, i)) == (k if k <= decontaminate.budget(len(item)) else None)


def test_decontamination_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "The cat sat on the mat and the dog"), (2, None), (3, "short"), (None, "one two three four five six seven")], "item_id long, text string")
    got = decontaminate.contaminated(odd, bench).collect()
    assert [(x.doc_id, x.item_id, x.edits) for x in got] == [(5, 1, 0)]
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.clean(odd, bench.limit(0)).count() == len(ODD)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    rows = [(i, " ".join(f"word{r.randint(0, 3000)}" for _ in range(60)), "en", r.choice("abc"), 0) for i in range(60)]
    rows += [(100 + i, rows[0][1], "en", "a", 0) for i in range(5)] + [(200, rows[1][1] + " the answer to the benchmark is forty two indeed", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "The answer to the benchmark is forty-two indeed")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {x.doc_id for x in got}
    assert ids and not ids & {200, 100, 101, 102, 103, 104} and len(corpus_pipeline.STAGES) == 5

"""Operators against brute force, round trips and held-out labels."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from flowspark.llm import html_blocks, mixing, personal_data, quality_rules, queries, secret_scan, shingle_sets, simhash, string_tiling, token_count, toxicity, training_order

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")


def test_fingerprints_by_definition(texts):
    import xxhash

    for text in list(texts.values())[:40] + ["", "a", "a b c", "A b\tc d e"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text) == want


@pytest.mark.parametrize("block", [4096, 16])
def test_links_by_all_pairs(spark, block):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 1]
    fps = set(base)
    for x in base:
        for _ in range(6):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(a)}  # a crowded bucket
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, block=block)).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 4:
                a, b = find(signed[i]), find(signed[j])
                root[max(a, b)] = min(a, b)
    assert {x: find(x) for x in signed} == {x: roots.get(x, x) for x in signed}


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 1000, 4097):
        p = training_order.Permutation(n, 5)
        slots = p.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert (p.sequence(slots) == np.arange(n)).all()


def test_shards_round_trip(spark, texts, tmp_path):
    import tiktoken

    ranks, pattern, eos = queries.byte_vocabulary()
    rows = [*texts.items()][:30] + [(900, None), (901, ""), (902, "a  b   c\n  d \n"), (902, "a  b"), (None, " x"), (903, "y "), (904, " "), (905, "a\u3000\u00a0b c\u2003 d\x1c\x1de\n\nf \ng\u00a0h")]
    docs = frame(spark, rows).coalesce(1)
    path = str(tmp_path / "shards")
    held = {r["sequence"]: r for r in training_order.materialise(docs, ranks, pattern, eos, path, length=64, shard_records=16).collect()}
    back = sorted(training_order.read_shards(spark, path, 64, 16).collect(), key=lambda r: r["sequence"])
    assert sorted(r["slot"] for r in back) == list(range(len(back))) and all(held[r["sequence"]]["slot"] == r["slot"] for r in back)
    assert all(r["slot"] == r["shard"] * 16 + r["position"] for r in back)
    encode = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    stream = np.frombuffer(b"".join(r["tokens"] for r in back), "<u2").tolist()
    want, owners = [], []
    for i, t in docs.collect():
        ids = [*encode(t or ""), eos]
        want += ids
        owners += [i] * len(ids)
    assert stream[: len(want)] == want and set(stream[len(want) :]) <= {eos} and len(stream) - len(want) < 64
    assert all(set(r["doc_ids"]) == set(owners[s * 64 : s * 64 + 64]) for s, r in held.items())
    later = training_order.read_shards(spark, path, 64, 16, from_slot=37).collect()
    assert sorted(r["slot"] for r in later) == list(range(37, len(back)))


def test_token_counts_equal_tokenizers(spark, texts):
    from tokenizers import Tokenizer, models

    vocabulary = token_count.load_vocabulary(f"{queries.TOKENIZERS}/{queries.UNIGRAM_FILE}")
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.items()], 0, False))
    count = token_count.counter(vocabulary)
    some = [*texts.values()][:120] + ["漢字 \U0001f600x", "  two  spaces ", "\n\t", "aaaaaaaaaaaaaaaa" * 20, " ", "a▁b c", "x "]
    for text, found in zip(some, count(pa.array(some)).tolist(), strict=True):
        tokens = model.encode("▁" + text.replace(" ", "▁")).tokens
        assert found == sum(1 if t in vocabulary else len(t.encode()) for t in tokens)
    assert count(pa.array([None, ""], pa.string())).tolist() == [0, 0]


def test_tiles_by_definition():
    rng = random.Random(3)
    for _ in range(150):
        item = [rng.choice("abcd") for _ in range(rng.randint(5, 18))]
        doc = [rng.choice("abcd") for _ in range(rng.randint(5, 40))]
        doc[3:3] = item[2:9]
        free_i, free_d, covered = [True] * len(item), [True] * len(doc), 0
        while True:  # longest common free run; the first in the document, then in the item
            best = (0, 0, 0)
            for j in range(len(doc)):
                for i in range(len(item)):
                    n = 0
                    while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_i[i + n] and free_d[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            n, i, j = best
            if n < string_tiling.SHORTEST:
                break
            free_i[i : i + n], free_d[j : j + n] = [False] * n, [False] * n
            covered += n
        found = list(string_tiling.Benchmark([(1, " ".join(item))]).shared(" ".join(doc)))
        assert sum(sum(f[2]) for f in found) == covered
        number = {w: i for i, w in enumerate("abcd")}
        by_length = string_tiling.tile_by_length(*(np.array([number[w] for w in x]) for x in (item, doc)))
        assert sorted(t[2] for t in by_length) == sorted(n for f in found for n in f[2])


def test_reordered_passage_is_found(spark):
    words = [f"w{i}" for i in range(40)]
    docs = frame(spark, [(1, " ".join(["x"] * 30 + words[20:] + ["y"] * 5 + words[:20])), (2, " ".join(words[:12] + ["z"] * 30)), (3, None), (4, "")])
    bench = spark.createDataFrame([(7, " ".join(words)), (8, None), (9, "one two")], "item_id long, text string")
    rows = string_tiling.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["tiles"], r["covered"]) for r in rows] == [(1, 7, 2, 40)]
    assert {r["doc_id"] for r in string_tiling.decontaminate(docs, bench).collect()} == {2, 3, 4}


def test_repeated_words_by_definition():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 30))]
        wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        counts = Counter(wins)
        hit = {j for i, w in enumerate(wins) if counts[w] > 1 for j in range(i, i + 8)}
        assert quality_rules.repeated_words(words) == len(hit)


def base_columns(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n")]
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(wins)
    repeat = len({j for i, w in enumerate(wins) if counts[w] > 1 for j in range(i, i + 8)})
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, len(words) < 20 or 100 * repeat > 30 * len(words)


def test_quality_base_by_definition(spark, texts):
    odd = [None, "", " ", "\n\n", "a\nb\na\n a\n\na", "\u00a0 x\x0b#*\x0c&\x1c y", "a b c d e f g h i " * 9, "line one\r\nline two\r\nline one\r\n" * 3, "\U0001f600 <b>|$%" * 30]
    rows = [*texts.items()] + [(10_000 + i, t) for i, t in enumerate(odd)]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows), labels).collect()}
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_columns(text), text
        assert not (r["kept"] and r["base_failed"])


def test_quality_parts_good_from_bad(spark):
    """On labelled rows that neither trained nor set the threshold."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    rows = quality_rules.judge(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("kept").alias("n")).collect()
    share = {r["quality"]: r["kept"] for r in rows}
    assert sum(r["n"] for r in rows) > 100 and share[1] > 0.9 and share[0] < 0.1


def cut_by_definition(good, bad):
    """The best cut of balanced accuracy, over fractions; the lowest of equal ones."""
    every = sorted({*good, *bad})
    cuts = [-np.inf, *((a + b) / 2 for a, b in zip(every, every[1:], strict=False))] if good and bad else [-np.inf]
    below = lambda xs, cut: int(np.searchsorted(xs, cut))
    good, bad = sorted(good), sorted(bad)
    return max(cuts, key=lambda cut: below(bad, cut) * len(good) - below(good, cut) * len(bad))


def test_quality_learns_from_all_labels(spark):
    """Scores and verdicts by definition, with more labelled rows than the 20,000 that once were read at most."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    n = 24_000
    quality = (rng.random(n) < 0.7).astype(int)
    words = np.where(rng.random((n, 22)) < np.where(quality, 0.5, 0.4)[:, None], rng.integers(0, 40, (n, 22)), rng.integers(40, 400, (n, 22)))
    texts = [" ".join(f"w{w}" for w in row) for row in words]
    docs = frame(spark, [*enumerate(texts), (n, "no label " * 12)])
    labels = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quality)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    half = dict(docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)) == 0).collect())
    bits = quality_rules.bucket_bits(sum(map(len, texts)) + 108)
    hasher = quality_rules.Hasher(bits)
    buckets = [hasher.buckets(quality_rules.words_of(t)) for t in [*texts, "no label " * 12]]
    raw = np.bincount(np.concatenate(buckets), minlength=1 << bits)
    trusted = np.bincount(np.concatenate([buckets[i] for i in range(n) if half[i] and quality[i]]), minlength=1 << bits)
    weights = quality_rules.log_ratio(trusted, raw)
    score = [float(weights[b].mean(dtype=np.float64)) for b in buckets]
    assert max(abs(got[i]["score"] - score[i]) for i in range(n + 1)) < 1e-12
    limit = cut_by_definition(*([score[i] for i in range(n) if not half[i] and quality[i] == q] for q in (1, 0)))
    assert limit > -np.inf and all(got[i]["kept"] == (not got[i]["base_failed"] and score[i] >= limit) for i in range(n + 1))


def test_threshold_by_definition(spark):
    rng = random.Random(9)
    for good, bad in [(0, 0), (0, 5), (5, 0), (1, 1), (40, 7), (300, 500)]:
        rows = [(q, rng.randrange(0, 60) / 64 + 0.1 * q) for q, k in ((1, good), (0, bad)) for _ in range(k)]
        want = cut_by_definition(*([s for q, s in rows if q == k] for k in (1, 0)))
        assert quality_rules.best_threshold(spark.createDataFrame([*rows, (None, 0.5), (2, 0.4), (1, None)], "quality int, score double")) == want


def test_buckets_grow_with_the_texts():
    bits = [quality_rules.bucket_bits(n) for n in (0, 10**6, 10**9, 10**12, 10**14)]
    assert bits == sorted(bits) and bits[0] == 14 and bits[2] == 16 and bits[3] == 21 and bits[4] == 25


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            luhn = sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
            good = {"email": True, "ip": max(map(int, m[0].split("."))) <= 255 if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark, texts):
    odd = ["a@b.cd@e.f x", "a@b.c_d@e.f g@h.i", "1.2.3.4.5.6.7.8 999.1.1.1 00255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (555) 123-4567 +12", "\U0001f600 a@b.c \U0001f600 1.2.3.4", "", None]
    odd += ["x" * 100 + "1" * 5000, "4111111111111111 " * 600]
    rows = [*texts.items()] + [(-1 - i, t) for i, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in personal_data.digest(personal_data.find(frame(spark, rows))).collect()}
    for i, text in rows:
        assert got[i]["base_sha256"] == hashlib.sha256(base_spans(text).encode()).hexdigest(), text
        assert got[i]["n_id"] == 0, text


def test_personal_data_found_by_context(spark, texts):
    """Identifiers of other forms beside words that known ones stand beside, on either side, in a list, and
    beside words that only identifiers found before them point to."""
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, planted = [*texts.items()], {}

    def plant(text, *spans):
        planted[50_000 + len(planted)] = set(spans)
        rows.append((50_000 + len(planted) - 1, f"{text.format(*spans)} and so on"))

    for i in range(20):
        plant(f"he said my address is always 10.0.{i}.7")
        plant(f"then write to user{i}@mail.example.org if needed")
    for i in range(8):
        plant("he said my address is always {}, and went", f"fe80:{number(4)}:zz")
        plant("then write to {} or", f"jane.doe{i}@intranet")
        plant("so {} if needed", f"AB-{number(6)}")
    ids = [f"{number(3)} {number(2)} {number(4)}" for _ in range(12)]
    for x in ids:
        plant("my address is always {} yes", x)
        plant("passport holder {} was seen", x)
    for _ in range(6):
        plant("passport holder {} came", f"X{number(7)}")
    for i in range(30):  # numbers beside common words are left alone
        rows.append((90_000 + i, f"they sold about {number(5)} of them in the year {1900 + i} there"))
    text = dict(rows)
    got = {r["doc_id"]: r for r in personal_data.digest(personal_data.find(frame(spark, rows))).collect()}
    found = {i: {text[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "id"} for i, r in got.items()}
    wanted = sum(len(v - {""}) for v in planted.values())
    hit = sum(len(found[i] & v) for i, v in planted.items())
    assert hit >= 0.9 * wanted, (hit, wanted, [v for i, v in planted.items() if v - found[i] - {""}][:20])
    assert all(not v or i in planted for i, v in found.items())
    assert sum(len(found[i]) for i in planted) == hit


def test_secrets(spark, texts):
    docs = frame(spark, texts.items())
    more = frame(spark, [(5000 + i, f'see token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and {4111111111111111 + i} here') for i in range(60)])
    all_ = docs.union(more)
    text = dict(all_.collect())
    rows = secret_scan.scan(all_).collect()
    hits = [(text[r["doc_id"]][r["start"] : r["end"]], text[r["doc_id"]][max(0, r["start"] - 9) : r["start"]], r["is_secret"]) for r in rows]
    assert all(secret for _, before, secret in hits if "token = " in before) and sum("token = " in b for _, b, _ in hits) >= 60
    assert not any(secret for value, _, secret in hits if value.isdigit())


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["toxic"] == r["predicted"] for r in rows) / len(rows) > 0.9
    assert sum(r["predicted"] for r in rows if r["toxic"]) > 0.5 * sum(r["toxic"] for r in rows)


def test_mix_takes_near_the_target(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs)
    rows = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max("copies").alias("copies")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 4 * r["most"] and r["copies"] <= 3 for r in rows)
    assert mixing.take(docs, mixing.drawn(docs)).count() == mixed.agg(F.sum("copies")).first()[0]


def test_words_are_counted_without_holding_them(spark):
    from pyspark.sql import functions as F

    odd = [None, "", " ", "\n\n", " a", "a ", " a b\t\x0b\x0cc \r", "  \x85 \x00 \x1c", "\U0001f600 \U0001f600\U0001f600 $1 \\1", "a" * 70_000, "b " * 60_000, " " * 70_000, "\u00a0a\u3000b c"]
    docs = frame(spark, enumerate(odd))
    rows = docs.select("doc_id", mixing.words_in(F.col("text"))).collect()
    assert dict(rows) == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(odd)}
    seen, keep = [], mixing.stored
    mixing.stored = lambda df, label: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, label)
    try:
        mixing.drawn(docs.withColumn("source", F.lit("s")))
    finally:
        mixing.stored = keep
    assert len(seen) == 1 and "regexp_replace" in seen[0] and "regexp_extract_all" not in seen[0]


def test_main_text():
    page = "<html><head><title>T</title></head><body><nav>Home | About</nav><article><h1>Title</h1><p>First &amp; best\n text.</p><div class='ad-box'>Buy</div><p>Second.</p></article><footer>(c)</footer></body></html>"
    assert html_blocks.main_text(page) == "Title First & best text. Second."
    assert html_blocks.main_text(None) == html_blocks.main_text("") == ""


def test_main_text_by_windows():
    body = ["The council met on Monday and spoke for three hours about the new bridge over the river.", "Yes.", "It will be built within two years, said the mayor, and paid for by the state and the town."]
    advert = "<div class='ad'>Buy</div>"
    paragraphs = advert.join(f"<p>{p}</p>" for p in body)
    # The body stands in a <div>; the only <article> is a teaser.
    teaser = "<body><div>" + paragraphs + "</div><article><h3>More</h3><p>Read on</p></article></body>"
    assert html_blocks.main_text(teaser) == " ".join(body)
    # Without a frame: a short paragraph between two adverts stays, a lone line and a list of links do not.
    assert html_blocks.main_text(f"<body><p>Hi there</p>{advert}<div>{paragraphs}</div>{advert}<ul><li><a href='/'>{body[0]}</a></li></ul></body>") == " ".join(body)
    # In a frame that holds most of the text: what stands around it goes, short lines inside stay.
    framed = f"<body><div>Our town, every day</div><article>{paragraphs}{advert}<p>By Ann</p></article><div>Site made by a firm that likes short lines</div></body>"
    assert html_blocks.main_text(framed) == " ".join([*body, "By Ann"])


@pytest.mark.parametrize("block", [512, 5])
def test_near_copies_by_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_sets, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for i in range(60):  # more than SMALL texts in some groups
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(40, 300))]
        for _ in range(20 if i < 3 else 3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * rng.choice((1, 2, 8)) // 100)):
                copy[at] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 100
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    assert not any(i in kept and j in kept for i, j in near)
    alone = set(range(len(rows))) - {i for pair in near for i in pair}
    far = {r["doc_id"] for r in simhash.near_duplicates(frame(spark, rows)).filter("doc_id = component_id").collect()}
    assert alone & far <= kept


def test_secrets_bare_glued_and_short(spark):
    key = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    rows = [(i, f"set api_key={k} and AWS_SECRET={k[::-1]} here") for i, k in enumerate(key)]
    rows += [(100 + i, f"then {k} came up again beside {4111111111111111 + i} there") for i, k in enumerate(key)]
    rows += [(200, "password: hunterXq, then"), (201, "pad secret=QUJDREVGR0hJSktMTU5PUA== end")]
    text = dict(rows)
    found = [(r["doc_id"], text[r["doc_id"]][r["start"] : r["end"]], r["is_secret"]) for r in secret_scan.scan(frame(spark, rows)).collect()]
    values = {(i, v) for i, v, _ in found}
    assert all({(i, k), (i, k[::-1])} <= values for i, k in enumerate(key))
    assert (200, "hunterXq") in values and (201, "QUJDREVGR0hJSktMTU5PUA==") in values
    assert all(secret for i, v, secret in found if i < 200 and not v.isdigit())
    assert not any(secret for _, v, secret in found if v.isdigit())


def test_main_text_in_wrappers_with_telling_names():
    body = "".join(f"<p>{p}</p>" for p in ["A long paragraph that the article of this page has, with some words more.", "Short.", "Another paragraph of the article, also with a number of words."])
    text = html_blocks.main_text(f"<body><article>{body}</article></body>")
    assert text.startswith("A long") and text.endswith("words.")
    for open_, close in (
        ("<article class='post has-sidebar'>", "</article>"),
        ("<article class='hentry comments-open'>", "</article>"),
        ("<div class='content no-sidebar'>", "</div>"),
        ("<section id='search-engines'>", "</section>"),
        ("<form id='aspnetForm'><div>", "</div></form>"),
        ("<div class='layout sidebar-right'>", "</div>"),
        ("<div class='social-policy'><article>", "</article></div>"),
        ("<div class='footer-fixed'><main>", "</main></div>"),
    ):
        assert html_blocks.main_text(f"<body><nav><a href='/'>Home</a></nav>{open_}{body}{close}<footer>end</footer></body>") == text, open_
    comments = "".join(f"<article class='comment'><p>{'I think that this is all wrong and say so. ' * 9}</p></article>" for _ in range(9))
    for open_ in ("<div id='comments'>", "<section class='comment-list'>", "<div class='reader-comments'>"):
        assert html_blocks.main_text(f"<body><article>{body}</article>{open_}{comments}</div></section></body>") == text, open_
    assert html_blocks.main_text(f"<body><article>{body[:80]}<div class='google-ads'>Buy this</div>{body[80:]}<form>Name <input></form></article></body>") == text
    # Never closed: the advert ends where the article begins.
    assert html_blocks.main_text(f"<body><div class='ad'>Buy this<article>{body}</article></body>") == text


def test_main_text_takes_linear_time():
    import time

    for page in ("<div>" * 100_000 + "</section>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<div class=ad>" * 100_000 + "x<p>" * 20_000, "<form>" * 50_000 + "</form>" * 50_000):
        began = time.time()
        html_blocks.main_text(page)
        assert time.time() - began < 3


def naive_main_text(lines):
    """The line-block rule by its words: ``lines`` is (text, weight)."""
    n = html_blocks.WIDTH
    sums = [sum(w for _, w in lines[i : i + n]) for i in range(len(lines))]
    surge, kept, on = max(1, min(html_blocks.SURGE, max(sums, default=0) // 4)), [], False
    for (line, _), total in zip(lines, sums, strict=True):
        on = total > 0 if on else total >= surge
        if on and line:
            kept.append(line)
    return " ".join(kept)


def test_main_text_by_naive_windows():
    rng = random.Random(2)
    for _ in range(200):
        lines = [("x" * rng.choice((1, 5, 30, 120)), True) if rng.random() < 0.5 else ("", False) for _ in range(rng.randint(1, 25))]
        for frame_ in (("<body>", "</body>", 1), ("<body><article>", "</article></body>", html_blocks.INSIDE)):
            # An empty line of the test is a dropped element: three empty lines.
            page = frame_[0] + "".join(f"<section><p>{t}</p></section>" if t else "<nav>m</nav>" for t, _ in lines) + frame_[1]
            flat = [x for t, _ in lines for x in ([(t, len(t) * frame_[2])] if t else [("", 0)] * html_blocks.WIDTH)]
            if frame_[2] > 1:
                flat = [("", 0)] * html_blocks.WIDTH + flat
            assert html_blocks.main_text(page) == naive_main_text(flat)


def test_repeated_word_and_several_blocks(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(40))) for i in range(60)]
    items += [(100, "again " * 10_000), (101, items[0][1]), (102, " ".join(f"long{i}" for i in range(300)))]
    rows = [(i, f"x {' '.join(t.split()[20:])} y z {' '.join(t.split()[:20])} end") for i, t in items[:30]]
    rows += [(500, "again " * 1_000_000), (501, "clean words that stand in no item at all"), (502, " ".join(f"long{i}" for i in range(60, 115))), (503, " ".join(f"long{i}" for i in range(20)))]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i) for i in range(30)} | {(0, 101), (500, 100), (502, 102)}
    one = {(r["doc_id"], r["item_id"]) for r in string_tiling.contaminated(docs, bench).collect()}
    assert one == want
    monkeypatch.setattr(string_tiling, "BLOCK_WORDS", 4000)
    several = string_tiling.contaminated(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in several.collect()} == want
    assert {r["doc_id"] for r in string_tiling.decontaminate(docs, bench).collect()} == {501, 503}


def test_filters_judge_rows_not_ids(spark):
    leak, clean = " ".join(f"w{i}" for i in range(30)), "some other text that is clean"
    docs = spark.createDataFrame([(None, leak, "s", 1), (None, clean, "s", 2), (5, clean, None, 3), (5, leak, None, 4), (5, None, None, 5)], "doc_id long, text string, source string, n_chars long")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted(r["n_chars"] for r in string_tiling.decontaminate(docs, bench).collect()) == [2, 3, 5]
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (3, c, 4), (3, d, 5), (None, d, 6), (None, "only here " * 9, 7), (4, b, 8), (9, "twice " * 5, 9), (9, "twice " * 5, 10), (None, "only here " * 9, 11)]
    docs = spark.createDataFrame([(i, t, "s", n) for i, t, n in rows], "doc_id long, text string, source string, n_chars long")
    kept = sorted(r["n_chars"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept[:4] == [1, 3, 4, 5] and len(kept) == 6 and kept[4] in (7, 11) and kept[5] in (9, 10, 11) and {6, 8}.isdisjoint(kept)
    mixed = mixing.drawn(docs)
    taken = mixing.take(docs, mixed)
    assert sum(r["copies"] for r in mixing.mix(docs).collect()) == taken.count()
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    fit = [(i, f"you {'idiot stupid' if i % 2 else 'lovely nice'} word{i} and more word{i * 7} here", "s", i) for i in range(400)]
    both = [(None, "you idiot stupid you stupid idiot", "s", 1000), (None, "you lovely nice and more here", "s", 1001), (7, "you lovely nice and more here", "s", 1002)]
    kept = {r["n_chars"] for r in toxicity.keep_clean(spark.createDataFrame(fit + both, docs.schema), labels).collect()}
    assert {1001, 1002} <= kept and 1000 not in kept


def test_toxicity_is_alike_on_every_run(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (3, 11):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append({r["doc_id"]: r["score"] for r in toxicity.score(docs.repartition(n), labels.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def findings(seed, n):
    """(before, value, 1 for a secret) in many forms."""
    import base64

    rng = random.Random(seed)
    text = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for _ in range(n):
        yield "and ", text(digits + "abcdef", rng.choice((32, 40, 64))), 1
        yield 'api_key = "', text(letters + letters.upper() + digits, 32) + "7", 1
        yield "Bearer ", base64.b64encode(rng.randbytes(30)).decode().rstrip("=").replace("/", "x") + "1", 1
        yield "see /", "usr/share/" + "/".join(rng.choice(("other", "their", "which", "about")) for _ in range(3)) + "/v2", 0
        yield "sum of ", text(digits, 18), 0
        yield "the ", "-".join(rng.choice(("other", "their", "which", "about", "would")) for _ in range(4)) + "-2", 0
        yield "release ", f"{rng.randrange(90)}.{rng.randrange(9)}.{rng.randrange(9)}-stable.{rng.randrange(900)}", 0


def test_secrets_from_labelled_findings(spark):
    train = [(before, before[-4:], value, float(y)) for before, value, y in findings(1, 60)]
    labelled = spark.createDataFrame(train, "before string, sign string, value string, label double")
    held = list(findings(2, 40))
    words = "other their which about would there people could first these water after "
    rows = [(i, f"{words * 5} {before}{value} {words}") for i, (before, value, _) in enumerate(held)]
    rows += [(10_000, "write to some.one.19@mail5.example.com or first_second_third_77@example.org now")]
    found = secret_scan.scan(frame(spark, rows), labelled).collect()
    called = {r["doc_id"] for r in found if r["is_secret"]}
    wanted = {i for i, (_, _, y) in enumerate(held) if y}
    assert len(called & wanted) >= 0.95 * len(wanted) and len(called & wanted) >= 0.95 * len(called)
    assert not [r for r in found if r["doc_id"] == 10_000]
    again = {(r["doc_id"], r["start"]): r["score"] for r in secret_scan.scan(frame(spark, rows).repartition(5), labelled.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["start"]): r["score"] for r in found}


BODY = "This is a body paragraph with quite a lot of words, commas and such, so that it is clearly text of an article."
PARAGRAPHS = f"<p>{BODY}</p><p>{BODY} {BODY}</p>"
TEXT = f"{BODY} {BODY} {BODY}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><h1>Head</h1><div class='share'><a href=x>Post</a></div>{PARAGRAPHS}</body>", f"Head {TEXT}"),
        (f"<body><h1>Head</h1><nav><a href=x>Home</a></nav>{PARAGRAPHS}</body>", f"Head {TEXT}"),
        (f"<body>{PARAGRAPHS}<div class='ad'>Buy!</div><p>The end.</p></body>", f"{TEXT} The end."),
        (f"<body>{PARAGRAPHS}<p><a href=x>Read the source</a></p></body>", f"{TEXT} Read the source"),
        (f"<body><div class='article-header'><h1>Head</h1></div>{PARAGRAPHS}</body>", f"Head {TEXT}"),
        (f"<article><div class='search'><p>{BODY}</p></div></article>", BODY),
        (f"<article><h1>X</h1><div class='alert'>{BODY}</div></article>", f"X {BODY}"),
        (f"<article><p>{BODY} Where <math><mi>x</mi></math> stands.</p></article>", f"{BODY} Where x stands."),
        (f"<article><p>{BODY}</p><div class='comments'>{BODY * 5}</div></article>", BODY),
        (f"<body><header><h1>Site</h1></header><div id='content'>{PARAGRAPHS}</div><footer>All rights</footer></body>", TEXT),
    ],
)
def test_main_text_keeps_the_whole_article(page, want):
    assert html_blocks.main_text(page) == want


@pytest.mark.parametrize("piece", ["a", "<title ", "<title", "<a '", "<a b=\"x", "<p ", "</title   ", "<script>", "<h1>", "<div class='ad'>", "&amp", "<article>"])
def test_main_text_is_linear(piece):
    import time

    began = time.process_time()
    html_blocks.main_text("<p>x</p><" + piece * (100_000 // len(piece)))
    assert time.process_time() - began < 1


def test_copies_of_a_row_are_dealt_to_many_tasks(spark):
    from pyspark.sql import functions as F

    docs = spark.range(202_000).select(F.when(F.col("id") < 200_000, -1).otherwise(F.col("id")).alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    out = mixing.take(docs, mixing.drawn(docs))
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.5 * sum(sizes)
    made = mixing.mix(docs)
    assert made.count() == 202_000 and made.agg(F.sum("copies")).first()[0] == sum(sizes)


def test_samples_are_bounded_in_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some text number "), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    for module, name in ((toxicity, "toxicity-sample"), (quality_rules, "quality-sample")):
        keep = module.stored

        def noted(df, label, keep=keep, name=name):
            out = keep(df, label)
            seen.extend([out.count()] if label == name else [])
            return out

        module.stored = noted
        try:
            if module is toxicity:
                toxicity.train(docs, labels, most=50)
            else:
                quality_rules.judge(docs, labels, most=50)
        finally:
            module.stored = keep
    assert seen == [50, 50]


@pytest.mark.parametrize(("block", "lowest"), [(512, 512), (7, 100)])
def test_star_of_near_copies_loses_no_link(spark, monkeypatch, block, lowest):
    """Texts around a base, many of whose pairs are just above or just below the similarity.

    With 512 hashes at hand all sets are whole there; with fewer, pairs are sifted by a sample first.
    """
    monkeypatch.setattr(shingle_sets, "BLOCK", block)
    monkeypatch.setattr(shingle_sets, "LOWEST", lowest)
    monkeypatch.setattr(shingle_sets, "SMALL", 2)
    rng = random.Random(5)
    rows = []
    for g in range(3):
        base = [f"w{g}x{i}" for i in range(200)]
        for _ in range(60):
            copy = list(base)
            for at in rng.sample(range(200), rng.choice((2, 3, 6))):
                copy[at] = f"z{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                linked += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {find(i) for i in range(len(rows))}
    assert linked > 50 and len(want) > 3
    docs = frame(spark, rows)
    from pyspark.sql import functions as F

    first = docs.select(F.struct(F.lit(False).alias("no_id"), "doc_id", shingle_sets.text_key().alias("key")).alias("first"))
    got = {r["doc_id"] for r in shingle_sets.near_copies(docs, first).collect()}
    assert got == want


def test_secrets_in_urls_after_is_and_of_issued_forms(spark):
    want = {1: "s3cr3tPw0rd", 2: "hunter2pass", 3: "ghp_" + "abcdefgh" * 5, 4: "AKIA" + "ABCDEFGH" * 2, 5: "kfjgkfjg"}
    lines = {1: f"see postgres://bob:{want[1]}@db.example:5432/x", 2: f"so my pwd is {want[2]} now", 3: f"({want[3]})", 4: f"key {want[4]}, used", 5: f"redis://:{want[5]}@cache/0", 6: "mail bob@example.org at http://example.org:8080/path or this is hardly anything"}
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(20)]
    rows = [*lines.items(), *((100 + i, f"token = \"{k}\"") for i, k in enumerate(keys)), *((200 + i, f"order number {4111111111111111 + i} came") for i in range(20))]
    found = [(r["doc_id"], dict(rows)[r["doc_id"]][r["start"] : r["end"]], r["is_secret"]) for r in secret_scan.scan(frame(spark, rows)).collect()]
    assert {i: v for i, v, _ in found if i < 10} == want
    # Without labelled findings, what is announced or issued counts as one.
    assert all(s for i, v, s in found if i in (1, 2, 3, 4)) and not any(s for i, _, s in found if i >= 200)


def test_several_shards_a_task(spark, texts, tmp_path):
    ranks, pattern, eos = queries.byte_vocabulary()
    docs = frame(spark, [*texts.items()][:40]).coalesce(1)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = []
    for name, most in (("one", 4096), ("few", 3)):
        path = str(tmp_path / name)
        training_order.materialise(docs, ranks, pattern, eos, path, 64, 16, most_tasks=most)
        rows = training_order.read_shards(spark, path, 64, 16).orderBy("slot").collect()
        late = training_order.read_shards(spark, path, 64, 16, from_slot=37).orderBy("slot").collect()
        assert late == rows[37:] and [r["slot"] for r in rows] == list(range(len(rows))) and all(r["shard"] == r["slot"] // 16 for r in rows)
        got.append([(r["slot"], r["shard"], r["position"], r["sequence"], bytes(r["tokens"])) for r in rows])
    assert got[0] == got[1] and len(got[0]) > 16 * 6

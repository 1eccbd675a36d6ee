"""The training-data operators against brute force and exact round trips, and their edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm.digest import certified_percentiles, compress, estimates, merge_digests, partial_digests
from panelweave.llm.encoding import CharModel, Model, garbled_texts, restored_texts
from panelweave.llm.leakage import leaked_passages
from panelweave.llm.leakage import words as word_column
from panelweave.llm.nearest import nearest_in_series, nearest_times
from panelweave.llm.packing import differencing, fill_windows, pack_texts

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("wide", [2, 4000])
def test_nearest_matches_brute_force(spark, wide):
    rng = random.Random(1)
    left = [(rng.choice("abcd"), day(rng.randrange(900))) for _ in range(300)] + [(None, day(1)), ("a", None)]
    right = [(rng.choice("abc"), day(rng.randrange(900))) for _ in range(60)] + [("a", None), (None, day(1))]
    to = lambda rows, c: spark.createDataFrame([(*r, 1) for r in rows + rows[:9]], f"k string, {c} date, _t int")
    twelve = dt.timedelta(12)
    got = {tuple(r) for r in nearest_times(to(left, "t"), to(right, "u"), "k", "t", "u", twelve, wide).collect()}
    want = set()
    for k, t in left:
        near = [(abs((u - t).days), u) for kk, u in right if k and t and u and kk == k and abs((u - t).days) <= 12]
        if near:
            want.add((k, t, min(near)[1]))
    assert got == want
    assert nearest_times(to(left, "t").limit(0), to(right, "u"), "k", "t", "u", twelve).count() == 0
    assert nearest_times(to(left, "t"), to(right, "u").limit(0), "k", "t", "u", twelve).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_nearest_by_the_microsecond(spark, kind):
    rng = random.Random(2)
    at = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=rng.randrange(40_000_000))
    left, right = [(rng.choice([1, 2, 3]), at()) for _ in range(200)], [(rng.choice([1, 2]), at()) for _ in range(80)]
    far = dt.timedelta(microseconds=250_001)
    frame = lambda rows, c: spark.createDataFrame(rows, f"k long, {c} timestamp_ntz").withColumn(c, F.col(c).cast(kind))
    got = {(r[0], str(r[1]), str(r[2])) for r in nearest_times(frame(left, "t"), frame(right, "u"), "k", "t", "u", far).select("k", F.col("t").cast("string"), F.col("u").cast("string")).collect()}
    want = set()
    for k, t in left:
        near = [(abs(u - t), u) for kk, u in right if kk == k and abs(u - t) <= far]
        if near:
            want.add((k, t, min(near)[1]))
    clean = lambda x: x.strftime("%Y-%m-%d %H:%M:%S.%f").rstrip("0").rstrip(".")
    assert got == {(k, clean(t), clean(u)) for k, t, u in want}


def test_nearest_beyond_one_axis():
    import pyarrow as pa

    from panelweave.llm.nearest import _matcher

    year = 365 * 86_400_000_000
    left = pa.table({"_e": pa.array(range(9), pa.int64()), "_t": pa.array([k * 9000 * year for k in range(9)], pa.int64())})
    right = pa.table({"_e": pa.array(range(9), pa.int64()), "_t": pa.array([k * 9000 * year + (5 if k % 2 else 10**9) for k in range(9)], pa.int64())})
    assert _matcher(100)(left, right)["_e"].to_pylist() == [1, 3, 5, 7]


def test_nearest_in_series_keeps_rows(spark):
    left = spark.createDataFrame([(1, day(5), 9), (1, day(5), 9), (2, day(50), 9)], "id int, t date, u2 int")
    series = spark.createDataFrame([(day(3), 1.0), (day(7), 1.0)], "u date, v double")
    assert [tuple(r) for r in nearest_in_series(left, series, "t", "u", dt.timedelta(3)).select("id", "u").collect()] == [(1, day(3))] * 2


def test_digest_error_and_merging():
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(0, 4, 60_000))
    parts = [compress(np.zeros(len(p), int), p, np.ones(len(p))) for p in np.array_split(x, 25)]
    c, m, w = compress(np.zeros(sum(len(p[1]) for p in parts), int), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
    assert len(m) <= 501 and w.sum() == pytest.approx(60_000) and (np.diff(m) >= 0).all()
    x.sort()
    for q in (0.01, 0.25, 0.5, 0.9, 0.999):
        e = np.interp(q * 60_000, np.cumsum(w) - w / 2, m)
        assert abs(np.searchsorted(x, e) / 60_000 - q) < 0.005


def test_certified_percentiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.randrange(3), rng.choice([None, float("nan"), float("inf"), 7.0, 7.0, rng.gauss(0, 1) * 10 ** rng.randrange(6)])) for _ in range(3000)]
    rows += [(3, 0, 5.0), (4, 0, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "c int, d int, v double, estimate int").repartition(7)
    got = certified_percentiles(df, ["c"], ["d"], "v", [0.1, 0.5, 0.9]).collect()
    assert all(r.certified for r in got) and {r.c for r in got} == {1, 2, 3, None}
    for r in got:
        own = sorted(v for c, d, v in rows if c == r.c and (r.is_coarse or d == r.d) and v is not None and np.isfinite(v))
        assert r.n_values == len(own)
        lo, hi = sum(v < r.estimate for v in own), sum(v <= r.estimate for v in own)
        assert r.rank_error == pytest.approx(max(0, lo - r.q * len(own), r.q * len(own) - hi) / len(own))
    assert certified_percentiles(df.limit(0), ["c"], ["d"], "v", [0.5]).count() == 0


def test_digests_of_days_combine(spark):
    df = spark.range(20_000).select((F.col("id") % 5).cast("int").alias("d"), F.col("id").cast("double").alias("v"))
    whole = estimates(merge_digests(partial_digests(df.withColumn("k", F.lit(1)), ["k"], "v"), ["k"]), ["k"], [0.5]).first()
    days = merge_digests(partial_digests(df, ["d"], "v"), ["d"]).withColumn("k", F.lit(1))
    both = estimates(merge_digests(days.select("k", "_means", "_weights"), ["k"]), ["k"], [0.5]).first()
    assert whole.n_values == both.n_values == 20_000
    assert abs(whole.estimates[0] - 10_000) < 100 and abs(both.estimates[0] - 10_000) < 100


def test_differencing_keeps_items_and_balances():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(0, 900) for _ in range(rng.randrange(1, 80))]
        k = rng.randrange(1, 12)
        parts = differencing(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and len(parts) <= k
    sums = [sum(s) for s in (lambda z: [[z[i] for i in p] for p in differencing(z, 8)])([rng.randrange(1, 400) for _ in range(200)])]
    assert max(sums) - min(sums) < 20


def test_fill_windows():
    rng = random.Random(3)
    for top in (200, 900, 2047):
        sizes = [rng.randrange(0, top + 1) for _ in range(700)]
        parts = fill_windows(sizes, 2048)
        assert all(sum(sizes[i] for i in p) <= 2048 for p in parts) and sorted(i for p in parts for i in p) == list(range(700))
        if top < 1000:
            assert len(parts) <= -(-sum(sizes) // 2048) * 1.03 + 1
    assert len(fill_windows([1300] * 40, 2048)) == 40 and fill_windows([], 2048) == []


def test_pack_texts(spark):
    texts = ["a b c " * n for n in (1, 5, 700, 3, 3000)] + ["", None, "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, window_id int")
    rows = pack_texts(df.union(df.limit(2)), "doc_id", "text", capacity=512, batch_windows=4).collect()
    import tiktoken  # noqa: F401

    from panelweave.llm.packing import TOKENIZER, encoder

    for i, t in enumerate(texts):
        n = len(encoder(TOKENIZER).encode_ordinary(t or ""))
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.piece_no, r.window_id))
        times = 2 if i < 2 else 1
        assert sum(r.n_tokens for r in own) == n * times and len(own) == max(1, -(-n // 512)) * times
    full = {}
    for r in rows:
        full.setdefault(r.window_id, []).append((r.window_offset, r.n_tokens))
    for places in full.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 512
    assert pack_texts(df.limit(0), "doc_id", "text").count() == 0


def words(text):
    """Independent of the operator: character by character."""
    out, now = [], ""
    for c in (text or "") + " ":
        if c.isascii() and c.isalnum():
            now += c.lower()
        elif now:
            out.append(now)
            now = ""
    return out


def test_words_are_ascii_only(spark):
    texts = ["Ab-cK9 Ünd İx_1", "\u212aelvin ſ Kb", None, "", "a", " a  b "]
    got = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(word_column(F.col("text")).alias("w")).collect()]
    assert got == [words(t) for t in texts]


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, u in items:
            x = words(u)
            if grams & {tuple(x[k : k + run]) for k in range(len(x) - run + 1)}:
                out.add((d, i))
    return out


def cells(docs, items, run=12, altered=3, band=2):
    """Pairs by definition: of some run of item words all but `altered` stand at offsets of one cell."""
    out = set()
    for d, t in docs:
        w = words(t)
        for i, u in items:
            x = words(u)
            hits = {}
            for k, a in enumerate(x):
                for p, b in enumerate(w):
                    if a == b:
                        for c in ((p - k) // band, (p - k) // band - 1):
                            hits.setdefault(c, set()).add(k)
            if len(x) >= run and any(sum(k in h for k in range(s, s + run)) >= run - altered for h in hits.values() for s in range(len(x) - run + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("rows", [1_000_000, 3])
def test_leaks_match_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr("panelweave.llm.leakage.BROADCAST_ROWS", rows)  # 3: every join by a shuffle
    rng = random.Random(6)
    common = ["the", "of", "and", "a"]
    vocab = common * 6 + [f"w{i}" for i in range(60)]
    item = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 40))) for _ in range(15)] + ["the of and a the of and a the of and a the of", "short one", None, ""]
    items = list(enumerate(item)) + [(0, item[0]), (None, item[1])]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            x = (item[rng.randrange(16)] or "").split()
            a = rng.randrange(max(1, len(x) - 5))
            cut = x[a : a + rng.randrange(8, 16)]
            if rng.random() < 0.3 and len(cut) > 4:
                cut[3] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [c.upper() + rng.choice([",", " -", ""]) for c in cut]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, item[2] * 2), (502, item[2]), (None, item[2])]
    got = leaked_passages(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"), ).collect()
    usable = [d for d in docs if d[1] and d[0] is not None], [i for i in items if i[1] and i[0] is not None]
    assert {(r.doc_id, r.item_id) for r in got if r.kind == "phrase"} == brute(*usable, 12)
    assert {(r.doc_id, r.item_id) for r in got} == cells(*usable) and len(got) == len(cells(*usable))
    text, item_of = dict(docs), dict(items[:19])
    for r in got:
        if r.kind == "phrase" and r.doc_id < 500:
            w, x = words(text[r.doc_id]), words(item_of[r.item_id])
            assert w[r.doc_pos : r.doc_pos + r.run_words] == x[r.item_pos : r.item_pos + r.run_words]
    only = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), altered=0).collect()
    assert {(r.doc_id, r.item_id) for r in only} == brute(*usable, 12) and {r.kind for r in only} == {"phrase"}


def test_leaks_proximity_and_empty(spark):
    ws = [f"w{i}" for i in range(20)]
    mixed = ws[:5] + ["x"] + ws[5:10] + ["y"] + ws[10:16]
    docs = spark.createDataFrame([(1, " ".join(mixed)), (2, " ".join(ws))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(ws))], "item_id long, text string")
    got = leaked_passages(docs, items)
    assert {r.kind for r in got.where("doc_id = 1").collect()} == {"proximity"}
    assert "phrase" in {r.kind for r in got.where("doc_id = 2").collect()}
    assert leaked_passages(docs.limit(0), items).count() == 0 == leaked_passages(docs, items.limit(0)).count()


@pytest.mark.parametrize("elsewhere", ["", "w9"])
@pytest.mark.parametrize("missing", [[9], [4, 9, 14]])
def test_leaks_with_replaced_words(spark, missing, elsewhere):
    ws = [f"w{i}" for i in range(20)]
    post = ["other" if i in missing else w for i, w in enumerate(ws)]
    docs = spark.createDataFrame([(1, " ".join(post)), (2, " ".join(ws[:4] + ws[5:9] + ws[10:14])), (3, elsewhere), (4, " ".join(ws[:11]))], "doc_id long, text string")
    got = leaked_passages(docs, spark.createDataFrame([(1, " ".join(ws))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.kind) for r in got} == {(1, "proximity"), (2, "proximity"), (4, "proximity")}


CLEAN = [
    "Der Schlüssel für die größere Tür fehlt, möglicherweise müsst ihr ihn prüfen.",
    "J’ai essayé à côté de la fenêtre, c’est étrange « cassée », 20 € hélas.",
    "¿Cómo puedo añadir también la señal? ¡Funcionó! Según la configuración, está vacía.",
    "ATENÇÃO: NÃO use a função, então só à mão. São três opções, já está.",
    "Нужно сначала прочитать файл, а затем проверить таблицу. Спасибо, всё заработало.",
    "次に新しいテーブルを変更するとエラーになります。何回も試しましたが、設定は変わりません。",
    "The sign says “CAFÉ” on one side and CANAPÉ® or CAFÉ™ on the other, PERCHÉ… «OLÉ» „MENÜ“.",
    "The variable Â denotes the matrix and Ã its smoothed version; Dæmon Ð, Ångström, 5 µm, ±3 °C, §4, ½.",
    "Write `Ã©` and `â€™` when you mean é and ’, never `�` please.",
    "СРОЧНО! ВНИМАНИЕ: не удалять таблицу.",
    "plain ascii only", "", None,
]


def sloppy(raw, enc):
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


PAIRS = [("utf-8", e) for e in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251")]


def garbled():
    out = []
    for k, t in enumerate(CLEAN[:6]):
        for w, r in PAIRS:
            out.append((t, sloppy(t.encode(w), r)))
        out.append((t, sloppy(sloppy(t.encode("utf-8"), "cp1252").encode("utf-8"), "cp1252")))
        if k == 4:
            out += [(t, sloppy(t.encode("koi8_r"), "cp1251")), (t, sloppy(t.encode("cp1251"), "cp1252"))]
        if k == 5:
            out += [(t, sloppy(t.encode("euc_jp"), "latin-1")), (t, sloppy(t.encode("shift_jis"), "cp1252"))]
    return out


def corpus():
    return [t for t in CLEAN if t] * 40 + [g for _, g in garbled()]


def test_encodings_found_and_restored(spark):
    rows = list(enumerate(corpus())) + [(9001, None), (9002, ""), (9003, "lost caf� here"), (9003, "lost caf� here"), (9004, "only `�` shown")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, restored int")
    bad = {i for i, t in rows if t in {g for _, g in garbled()}} | {9003}
    got = [r.doc_id for r in garbled_texts(df).collect()]
    assert set(got) == bad and got.count(9003) == 2
    back = {r.doc_id: r for r in restored_texts(df).collect()}
    originals = {g: t for t, g in garbled()}
    texts = dict(rows)
    same = sum(back[i].restored == originals[texts[i]] for i in bad - {9003})
    assert same >= 0.95 * (len(bad) - 1)
    assert back[9003].complete is False and "�" in back[9003].restored
    assert garbled_texts(df.limit(0)).count() == 0


def test_passages_and_words():
    from collections import Counter

    text = "".join(corpus())
    counts = {"u" + c: n for c, n in Counter(text).items() if not c.isascii()} | {"ua": sum(map(str.isascii, text))}
    for run in (t for t in corpus() if "ё" in t):
        low = run.lower()
        for a, b in zip(low, low[1:]):
            if a > "Ё" and b > "Ё":
                counts["p" + a + b] = counts.get("p" + a + b, 0) + 1
    m = Model(counts)
    assert m.garbled("A plain text with one cafÃ© in it.") and m.garbled("it‚Äôs here") and m.garbled("itâ\x80\x99s")
    assert not m.garbled("A plain text with `cafÃ©` in code.") and m.garbled("`cafÃ©` and cafÃ©")
    assert m.restore("rÃ©sumÃ© `Ã©` isnâ€™t") == ("résumé `Ã©` isn’t", ["utf-8>cp1252"], True)
    assert isinstance(m.chars, CharModel)


def test_shift_jis_with_ascii_bytes():
    m = Model({"u" + c: 50 for c in "éüè’“”…テストサイウィキソース行に新しい"} | {"ua": 10_000})
    for word in ("テスト", "サイト", "ウィキ", "ソース", "行"):
        bad = sloppy(word.encode("shift_jis"), "cp1252")
        assert m.garbled(f"see {bad} here") and m.restore(f"see {bad} here")[0] == f"see {word} here"
    assert not m.garbled("It’s a café, l’été… “No”, the function ƒ(x) and naïve Zoë.")


def test_western_controls():
    m = Model({"u" + c: 50 for c in "éüè’“”…€™"} | {"ua": 10_000})
    assert m.restore("It\x92s \x93quoted\x94 for 5 \x80") == ("It’s “quoted” for 5 €", ["cp1252>latin-1"], True)
    assert m.restore("itâ\x80\x99s")[1] == ["utf-8>latin-1"]


def test_very_long_texts():
    m = Model({"u" + c: 50 for c in "éüè’“”Ã©¼â€™œ次に新しいテーブルを変更するとエラーになります。何回も試しましたが、設定は変わりません"} | {"ua": 100_000})
    plain = "次に新しいテーブルを変更するとエラーになります。" * 700
    assert m.spans(plain) == []
    assert m.garbled(plain + " cafÃ©")
    bad = sloppy(plain.encode("utf-8"), "cp1252")
    back = m.restore(bad)[0]
    assert abs(len(back) - len(plain)) < 100 and sum(a == b for a, b in zip(back[:3000], plain)) > 2900
    words_ = "rÃ©sumÃ© isnâ€™t " * 3000
    assert m.restore(words_)[0] == "résumé isn’t " * 3000


def counted(spark):
    from panelweave.llm.encoding import char_counts

    extra = ["La fenêtre était fermée, l'été dernier, à côté du café préféré.", "Der größte Schlüssel fällt natürlich über die Tür, schön.", "Он прочитал файл и проверил таблицу, а потом всё удалил. У меня получилось. Почему нельзя сделать иначе?"]
    return char_counts(spark.createDataFrame([(t,) for t in corpus() + extra * 60], "text string"))


def test_any_number_of_levels(spark):
    m = Model(counted(spark))
    for t in CLEAN[:2] + CLEAN[4:5]:
        bad = t[:30]
        for _ in range(7):
            bad = sloppy(bad.encode("utf-8"), "cp1252")
        assert m.restore(bad) == (t[:30], ["utf-8>cp1252"], True)


def test_what_cannot_be_restored_is_not_called_complete(spark):
    m = Model(counted(spark))
    for t, w, r in [("먼저 파일을 읽고 나서 표를 확인해야 합니다", "euc_kr", "cp1252"), ("Πρέπει πρώτα να διαβάσετε το αρχείο και μετά", "cp1253", "cp1252"), ("首先需要读取文件然后检查表格谢谢", "gb18030", "latin-1")]:
        bad = sloppy(t.encode(w), r)
        assert m.garbled(bad)
        back, _, complete = m.restore(bad)
        assert back == t or not complete


def test_other_pages(spark):
    m = Model(counted(spark))
    russian = "Почему нельзя прочитать файл? У меня получилось проверить таблицу."
    for w, r in [("iso8859_5", "latin-1"), ("koi8_r", "cp1252"), ("cp1251", "koi8_r"), ("mac_cyrillic", "cp1252"), ("cp866", "cp1251")]:
        assert m.restore(sloppy(russian.encode(w), r)) [0] == russian, (w, r)
    french = "La fenêtre était fermée, l'été dernier, à côté du café préféré."
    for w, r in [("cp1252", "mac_roman"), ("cp1252", "cp437"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252")]:
        assert m.restore(sloppy(french.encode(w), r))[0] == french, (w, r)
    for t in CLEAN:
        assert not m.garbled(t), t


def test_planted_texts(spark):
    from panelweave.llm.encoding import GARBLINGS, planted

    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(corpus())], "doc_id long, text string, garbling int")
    clean = [t for t in CLEAN[:4]]
    bad = planted(docs.where("doc_id < 4")).withColumn("doc_id", F.col("doc_id") * 100).drop("garbling")
    got = [(r.doc_id // 100, r.restored, r.complete) for r in restored_texts(bad, corpus=docs).collect()]
    assert sorted(got) == sorted((i, t, True) for i, t in enumerate(clean) for _ in GARBLINGS)


def test_bundles_and_roundtrip(spark):
    from panelweave.llm.packing import bundles, sequence_texts

    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 3, 40, 200]) for _ in range(900)]
    made = bundles(sizes, 32)
    assert [i for b in made for i in b] == list(range(900)) and all(len(b) == 1 or sum(sizes[i] for i in b) <= 32 for b in made)
    assert len(made) <= 2 * sum(sizes) / 32 + 1
    texts = ["Zoë's naïve café 次に 🙂 " * n for n in (0, 1, 2, 90, 700)] + ["x"] * 300 + [None]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    placed = pack_texts(docs, "doc_id", "text", capacity=256, batch_windows=8)
    got = {r.doc_id: (r.text, r.fits) for r in sequence_texts(docs, placed, capacity=256).collect()}
    assert got == {i: (t or "", True) for i, t in enumerate(texts)}


@pytest.mark.parametrize("groups", [100_000, 1])
def test_percentiles_counted_either_way(spark, groups, monkeypatch):
    monkeypatch.setattr("panelweave.llm.digest.BROADCAST_GROUPS", groups)
    monkeypatch.setattr("panelweave.llm.digest.SALT_ROWS", 100)
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("c"), (F.col("id") % 2).alias("d"), F.col("id").cast("double").alias("v")).repartition(5)
    got = certified_percentiles(df, ["c"], ["d"], "v", [0.5]).collect()
    assert len(got) == 6 and all(r.certified for r in got) and {r.n_values for r in got if r.is_coarse} == {1000, 2000}


def test_leaks_in_very_long_texts(spark):
    item = [f"w{i}" for i in range(30)]
    filler = ["the", "w3", "of", "w7"] * 15_000
    docs = spark.createDataFrame([(1, " ".join(filler + item[5:20] + filler)), (2, " ".join(filler))], "doc_id long, text string")
    got = leaked_passages(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.kind, r.doc_pos, r.item_pos, r.run_words) for r in got] == [(1, "phrase", 60_000, 5, 15)]

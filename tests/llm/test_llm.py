"""The training-data operators against brute force, exact round trips and small known cases."""

import datetime as dt
import random
import unicodedata

import pytest

llm = pytest.importorskip("menuflow.llm.queries")

from menuflow.llm import encode, language, name_mapping, packing, survivors, visual_text  # noqa: E402

FOLDER = "/opt/tokenizers"


# --- one form for text that looks the same


def test_forms():
    same = [("カレー", "ｶﾚｰ"), ("力レ一", "カレー"), ("ガ", "ｶﾞ"), ("ガ", "ガ"), ("ガ", "カ​゙"), ("Café", "Café"), ("Сооl", "Cool"), ("⼤⼈", "大人"), ("a　b", "a b"), ("﻿ a­", "a"), ("〜", "～"), ("~", "〜"), ("豈", "豈"), ("", " ​")]
    for a, b in same:
        assert visual_text.canonical(a) == visual_text.canonical(b), (a, b)
    other = [("a", "A"), ("か", "カ"), ("っ", "つ"), ("は", "ば"), ("①", "1"), ("²", "2"), ("㌘", "グラム"), ("a b", "ab"), ("O", "0")]
    for a, b in other:
        assert visual_text.canonical(a) != visual_text.canonical(b), (a, b)
    assert visual_text.canonical(None) is None


def test_invisible_signs_of_ascii_names():
    for a, b in [("Coo\x07l", "Cool"), ("\x00Cool\x7f", "Cool"), (" \x1f Cool", "Cool")]:
        assert visual_text.canonical(a) == visual_text.canonical(b) == b, ascii(a)
    assert visual_text.canonical("a\tb") == "a b"


def test_every_form_is_a_fixed_point():
    rnd = random.Random(2)
    signs = [chr(c) for c in (*range(32, 0x250), *range(0x300, 0x600), *range(0x2000, 0x2100), *range(0x2E80, 0x3100), *range(0xFF00, 0xFFF0), *range(0x4E00, 0x4F00), 0x1F468, 0xE0101)]
    for _ in range(3000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(1, 9)))
        once = visual_text.canonical(t)
        assert visual_text.canonical(once) == once, ascii(t)


def test_conflicts_are_found():
    with pytest.raises(visual_text.MappingConflict):
        visual_text.compile_mapping([("x", "a", "b"), ("y", "a", "c")])
    with pytest.raises(visual_text.MappingConflict):
        visual_text.compile_mapping([("x", "a", "b"), ("x", "b", "a")])
    assert visual_text.compile_mapping([("x", "a", "b"), ("x", "b", "c")])["a"] == "c"
    visual_text.compile_transducer(check=True)  # every output is a fixed point
    trie = visual_text.Trie()
    trie.add("ab", "x")
    with pytest.raises(visual_text.MappingConflict):
        trie.add("ab", "y")


def test_the_longest_key_wins():
    trie = visual_text.compile_transducer()
    assert trie.rewrite("\uff76\uff9e") == "\u30ac" and trie.rewrite("\uff76") == "\u30ab"  # ka with a half-width mark, and without
    assert trie.rewrite("\u041e\u0301") == "\u00d3"  # a Cyrillic letter with an accent is no key of Unicode's own
    assert trie.rewrite("\uff21\u0302\u0301") == "\u1ea4"  # a full-width letter with two marks: three signs beat two
    assert trie.rewrite("\u1100\u1161\u11a8") == "\uac01" and trie.rewrite("\u1100\u1161") == "\uac00"
    small = visual_text.Trie()
    for key, out in (("a", "1"), ("ab", "2"), ("abcd", "3")):
        small.add(key, out)
    assert small.rewrite("abcabcdaxab") == "2c31x2"


def test_every_way_of_composing_is_one_form():
    rnd = random.Random(9)
    pool = "aAeoс\u041e\u041aヵ\uff76\uff9e\uff9fカが\u3099\u309a\u0327\u0323\u0301\u0302\u0306\u0308가각\u11a8\u1100\u1161\u200b\u200d\u00c2\u1ea4\u0905\u093c "
    for _ in range(4000):
        t = "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 7)))
        once = visual_text.canonical(t)
        assert visual_text.canonical(unicodedata.normalize("NFD", t)) == visual_text.canonical(unicodedata.normalize("NFC", t)) == once, ascii(t)


def test_pairs(spark, rows):
    d = [(1, "c", "カレー", "x"), (2, "c", "ｶﾚｰ", "x"), (3, "c", "カレー", "x"), (4, "d", "ｶﾚｰ", "x"), (5, "c", None, "x"), (6, None, "カレー", "x"), (2, "c", "ｶﾚｰ", "x"), (None, "c", "力レー", "x")]
    df = spark.createDataFrame(d, "record_id bigint, chain string, name string, form string")
    assert rows(visual_text.look_same(df).select("record_id_a", "record_id_b")) == [(1, 2), (2, 3)]
    assert visual_text.look_same(df.limit(0)).count() == 0
    hot = spark.range(3000).selectExpr("id as record_id", "'c' as chain", "'same' as name").unionByName(spark.createDataFrame([(9999, "c", "sаme")], "record_id bigint, chain string, name string"))
    assert visual_text.look_same(hot).count() == 3000


# --- encoding


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    parts = ["The price is 970 yen. ", "新しいセットには、", "好きな飲み物が一つ付きます。\n", "<|endoftext|>", "it's  don't 's", "   ", "\r\n\r\n", "가격은 500원입니다. ", "ﾊﾟ𠮷👨‍👩‍👧", "　　", "é½ ———", "aaaa" * 40, "あ" * 90, "12345 678", "\u0085\x1c", "! ' \"", "\tx y"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(150)] + [None, "", " ", "'", "\n", "a" * 70_000, " " * 30_000 + "x", "字" * 30_000]


def test_pieces_encode_like_the_whole(texts):
    e = encode.encoder(FOLDER, "byte_bpe_50k")
    for t in texts:
        if not t:
            continue
        for mean in (8, 128):
            got = encode.pieces(t, mean)
            assert "".join(got) == t
            assert [i for p in got for i in e.encode_ordinary(p)] == e.encode_ordinary(t)


def test_corpus_is_encoded_exactly(spark, texts):
    e = encode.encoder(FOLDER, "byte_bpe_50k")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id bigint, text string, ids string").repartition(3)
    found = encode.encode_corpus(df).collect()
    assert len(found) == len(texts)
    for r in found:
        assert list(r["ids"]) == e.encode_ordinary(texts[r["doc_id"]] or "")
    counts = {r["doc_id"]: r["tokens"] for r in encode.token_counts(df).collect()}
    assert counts == {r["doc_id"]: len(r["ids"]) for r in found}
    assert encode.encode_corpus(df.limit(0)).count() == 0


def test_a_piece_in_every_document(spark):
    e = encode.encoder(FOLDER, "byte_bpe_50k")
    rnd = random.Random(3)
    shared = "".join(rnd.choice(["一部の店舗", "では、", "price ", "is 970 ", "ご了承ください。", "tax. "]) for _ in range(200))
    df = spark.range(3000).selectExpr("id as doc_id", f"concat(id, ' x. ', '{shared}', id) as text").coalesce(1)
    salts = encode._cut(df, "doc_id", "text", 128).selectExpr("salt", "size(docs) as n").groupBy().agg({"salt": "max", "n": "max"}).first().asDict()
    assert salts["max(salt)"] > 0 and salts["max(n)"] <= encode.PLACES
    for r in encode.encode_corpus(df).where("doc_id < 50").collect():
        assert list(r["ids"]) == e.encode_ordinary(f"{r['doc_id']} x. {shared}{r['doc_id']}")
    assert encode.token_counts(df).count() == 3000


# --- packing


@pytest.mark.parametrize("windows", [1, 8])
def test_packing(spark, windows):
    rnd = random.Random(6)
    sizes = [(i, rnd.choice([rnd.randint(1, 60), rnd.randint(1, 400)]), "x") for i in range(1500)] + [(9001, 0, "x"), (9002, None, "x"), (9003, 100, "x"), (9004, 1000, "x"), (None, 5, "x"), (9003, 100, "x")]
    items = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint, container string")
    limits = spark.createDataFrame([(1, 100), (2, 256), (None, 9), (3, 0)], "limit_id int, capacity int")
    found = [r.asDict() for r in packing.pack(items, limits, windows=windows, partitions=3).collect()]
    for limit, capacity in ((1, 100), (2, 256)):
        mine = [r for r in found if r["limit_id"] == limit]
        fill, parts = {}, {}
        for r in mine:
            fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
            parts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["size"]))
        assert max(fill.values()) <= capacity
        assert parts.keys() == {s[0] for s in sizes if s[0] is not None}
        for doc, size in {(s[0], s[1] or 0) for s in sizes if s[0] is not None}:
            p = sorted(parts[doc])
            assert sum(x[2] for x in p) == size and len(p) == max(1, -(-size // capacity))
            assert [x[1] for x in p] == [i * capacity for i in range(len(p))]
        if windows == 8:
            assert sum(fill.values()) / (len(fill) * capacity) > 0.95
    assert {r["limit_id"] for r in found} == {1, 2}
    assert packing.pack(items.limit(0), limits).count() == 0
    assert packing.pack(items, limits.limit(0)).count() == 0


# --- languages

SAMPLES = {
    "en": ["The kitchen needs four days to get this dish ready and we are sorry for the wait.", "My friends said they would come back for the soup because it was excellent."],
    "de": ["In einigen Filialen wird dieses Gericht nicht angeboten und der Preis ist nicht hoch.", "Zum neuen Menü gehört ein Getränk nach Wahl, das man auch mitnehmen kann."],
    "fr": ["Certains restaurants ne proposent pas ce plat et nous en sommes désolés.", "La nouvelle formule comprend une boisson au choix pour tous les clients."],
    "ja": ["一部の店舗では取り扱いがない場合がありますので、あらかじめご了承ください。", "揚げたての衣はサクサクで、中はとてもジューシーでした。"],
    "zh": ["部分门店没有这道菜，敬请谅解，下单之前请先查看一览表。", "我觉得酱汁有点太甜，不过米饭非常好吃。"],
}


def test_languages(spark, rows):
    docs = [(100 + i * 10 + k, (text + " ") * 3, lang, "x") for i, (lang, ts) in enumerate(SAMPLES.items()) for k in range(8) for text in [ts[k % 2]]]
    docs += [(900 + k, (SAMPLES["ja"][k % 2]) * 2, "zh-CN", "x") for k in range(3)]  # wrong labels in the sample
    odd = [
        (1, SAMPLES["de"][0], None, "x"), (2, SAMPLES["fr"][1], "EN_us", "x"), (3, SAMPLES["en"][0], "en-GB", "x"), (4, SAMPLES["ja"][0] + "\r\n\n" + SAMPLES["en"][1] * 3, "ja", "x"), (5, "!!! 123 ———", "en", "x"),
        (6, "", "en", "x"), (7, None, None, "x"), (8, "前に食べたcrispy beef curryのほうが好みで、衣はサクサクでした。", "JA", "x"), (9, SAMPLES["zh"][0], "und", "x"),
    ]
    df = spark.createDataFrame(docs + odd, "doc_id bigint, text string, lang string, paragraph string")
    profiles = language.fit_profiles(df, languages=tuple(SAMPLES))
    assert set(profiles) == set(SAMPLES)
    found = [r for r in rows(language.corrections(language.identify(df, profiles)).select("doc_id", "paragraph", "lang")) if r[0] < 100]
    assert found == [(1, 0, "de"), (2, 0, "fr"), (4, 0, "en"), (4, 1, "ja"), (4, 2, "en"), (9, 0, "zh")]
    fixed = rows(language.corrections(language.identify(df, profiles)).where("doc_id >= 900").select("doc_id", "lang"))
    assert fixed == [(900, "ja"), (901, "ja"), (902, "ja")]
    assert language.fit_profiles(df.limit(0)) == {}
    assert language.identify(df, {}).count() == 0


def plain_distances(profiles, size, text):
    """The out-of-place distances of one text, n-gram by n-gram."""
    from collections import Counter

    counts = Counter(language.grams(text))
    counts.pop("_", None)
    own = sorted(counts, key=lambda g: (-counts[g], g))[:size]
    ranks = {}
    for n in {counts[g] for g in own}:
        same = [i for i, g in enumerate(own) if counts[g] == n]
        ranks[n] = sum(same) / len(same)
    if not any(g in p for p in profiles.values() for g in own):
        return None
    return {lang: sum(abs(p[g] - ranks[counts[g]]) if g in p else size for g in own) / len(own) for lang, p in profiles.items()}


def test_distances_equal_a_plain_computation():
    from collections import Counter

    profiles = {}
    for lang, ts in SAMPLES.items():
        c = Counter(g for t in ts for g in language.grams(t) if g != "_")
        profiles[lang] = {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[:60])}
    rnd = random.Random(2)
    words = [w for ts in SAMPLES.values() for t in ts for w in t.split()] + ["l'été", "d'un'altro", "'x'", "<b class='y'>", "&nbsp;", "a@b.example", "https://x.example/y", "𠮷野家", "e\u0301t", "12", "—", "'"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ["", "!!!", "x" * 5000]
    judge = language.Judge(profiles, 60)
    has, d = judge.distances(texts)
    for t, ok, row in zip(texts, has, d):
        expected = plain_distances(profiles, 60, t)
        assert (expected is None) == (not ok), t
        if expected:
            assert [round(expected[x], 6) for x in judge.languages] == [round(float(v), 6) for v in row], t
    together = judge.many(texts)
    assert [x[:2] for x in together] == [judge.many([t])[0][:2] for t in texts]


# --- surviving records

S = survivors


def test_search_is_exact_under_dependencies():
    import itertools

    rnd = random.Random(8)
    deps = [S.Dependency(("a", "x"), ("b", "y"))]
    plan = [("a", 1, ["x"]), ("b", 1, ["y"]), ("c", 1, [])]
    for _ in range(200):
        records = [(k, rnd.choice("pqr"), rnd.choice("st"), rnd.randint(0, 4)) for k in range(rnd.randint(1, 6))]
        found = [("a", [t, -k], k, [x]) for k, x, y, t in records if rnd.random() < 0.8] + [("b", [t, -k], k, [y]) for k, x, y, t in records if rnd.random() < 0.8] + [("c", [t, -k], k, []) for k, x, y, t in records if rnd.random() < 0.8]
        pairs = {(x, y) for _, x, y, _ in records}
        found += [("", [0], 0, list(p)) for p in pairs]
        best = None
        options = {n: [f for f in found if f[0] == n] + [None] for n in "abc"}
        for a, b, c in itertools.product(options["a"], options["b"], options["c"]):
            if a and b and (a[3][0], b[3][0]) not in pairs:
                continue
            got = [z for z in (a, b, c) if z]
            order = tuple(tuple(z[1]) if z else (S.LOWEST - 1,) for z, n in ((a, "a"), (b, "b"), (c, "c")) if len(options[n]) > 1)
            score = (len(got), sum(z[1][0] for z in got), order)
            if best is None or score > best[0]:
                best = (score, {z[0]: z[2] for z in got})
        assert S.search(found, plan, deps) == best[1]


def test_survivors(spark, rows):
    t = dt.datetime
    day = dt.date
    ph = [{"date": "2026-01-01", "price": 5, "relaunch": None}]
    d = [
        (1, "p1", "n", "c", 1, "2025年1月5日", "s", "https://x.example/a", t(2025, 3, 1), day(2025, 2, 1), ph, "high", "x"),  # first seen after its last sight
        (2, "p2", "n", "c", 1, "2026-02-30", "s", "https://x.example/", t(2025, 4, 1), day(2025, 6, 1), ph * 2, None, "x"),
        (3, "p3", "n", "c", 1, "20250601", "s", "http://x.example/b/", t(2025, 4, 1), None, ph * 2, "low", "x"),
        (4, "p4", None, None, None, None, None, None, None, None, None, None, "x"),
        (5, "p5", "n", "c", 1, "未定", "s", "javascript:void(0)", t(1970, 1, 1), day(2025, 1, 1), [{"date": None, "price": 5, "relaunch": None}], "high", "x"),
    ]
    schema = "record_id bigint, product_id string, name string, category string, price int, launch_date string, launch_date_source string, official_url string, first_seen_at timestamp_ntz, last_seen_at date, price_history array<struct<date:string,price:int,relaunch:boolean>>, source string, bundle string"
    records = spark.createDataFrame(d, schema)
    trust = spark.createDataFrame([("high", 9), ("low", 1), (None, 99)], "source string, trust int")
    members = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7, 3), (7, 404), (8, 4), (8, 5), (None, 1)], "group_id bigint, record_id bigint")
    known, bundles = S.product_bundles(records, trust)
    assert rows(S.choose_bundles(known, members, bundles)) == [(7, "first_seen_at", 2), (7, "launch_date", 1), (7, "official_url", 1), (7, "price_history", 3)]
    assert S.choose_bundles(known, members.limit(0), bundles).count() == 0
    named = S.Bundle("identity", S.F.col("name").isNotNull(), [S.F.col("_trust")], ("product_id",), 1)
    joined = S.choose_bundles(known.withColumn("official_url", S.F.when(S.F.col("record_id") == 3, S.F.col("official_url"))), members, [named, *bundles], [S.Dependency(("identity", "product_id"), ("official_url", "official_url"))])
    assert (7, "official_url", 3) in rows(joined)


@pytest.mark.parametrize("order", ["ab", "ba"])
def test_pruned_pairs_equal_the_whole_search(spark, order):
    rnd = random.Random(11)
    records = [(k, rnd.choice([None, "p", "q", "r", "s"]), rnd.choice([None, "t", "u", "v"]), rnd.choice([None, *range(5)]), rnd.choice([None, *range(5)]), rnd.random() < 0.8, rnd.random() < 0.8) for k in range(900)]
    df = spark.createDataFrame(records, "record_id bigint, x string, y string, ra bigint, rb bigint, ua boolean, ub boolean")
    members = spark.createDataFrame([(k // 5, k) for k in range(900)], "group_id bigint, record_id bigint")
    a = S.Bundle("a", S.F.col("ua"), [S.F.col("ra")], ("x",), 1)
    b = S.Bundle("b", S.F.col("ub"), [S.F.col("rb")], ("y",), 1)
    bundles = [a, b] if order == "ab" else [b, a]
    depends = [S.Dependency(("a", "x"), ("b", "y"))]
    found = {(r["group_id"], r["bundle"]): r["record_id"] for r in S.choose_bundles(df, members, bundles, depends).collect()}
    plan = [(x.name, x.weight, list(x.fields)) for x in bundles]
    whole = {}
    for r in S.candidates(df, members, bundles, depends).groupBy("group_id").agg(S.F.collect_list(S.F.struct("bundle", "rank", "key", "agree")).alias("c")).collect():
        options = [(c["bundle"], c["rank"], c["key"], c["agree"]) for c in r["c"]]
        whole |= {(r["group_id"], name): k for name, k in S.search(options, plan, depends).items()}
    assert found == whole


def test_a_group_of_many_values_under_a_dependency(spark):
    df = spark.range(20_000).selectExpr("id as record_id", "concat('x', id) as x", "concat('y', id % 7000) as y", "id % 13 as r")
    members = spark.range(20_000).selectExpr("cast(1 as bigint) as group_id", "id as record_id")
    a, b = (S.Bundle(n, S.F.lit(True), [S.F.col("r")], (f,), 1) for n, f in (("a", "x"), ("b", "y")))
    found = {r["bundle"]: r["record_id"] for r in S.choose_bundles(df, members, [a, b], [S.Dependency(("a", "x"), ("b", "y"))]).collect()}
    assert found["a"] % 13 == 12 and found["b"] % 13 == 12 and found["a"] % 7000 == found["b"] % 7000


# --- names


def reference(seed=1):
    rnd = random.Random(seed)
    parts = [["濃厚", "まかない風", "屋台風", "月夜の", "大人の"], ["チーズ", "バジル", "醤油", "キムチ", "明太子"], ["チキン", "海老", "豆腐", "かぼちゃ", "まぐろ"], ["カレー鍋", "うどん", "ピザ", "餃子", "弁当"]]
    names = {"".join(rnd.choice(p) for p in parts) for _ in range(160)}
    return [(i, "ab"[i % 2], n, "x") for i, n in enumerate(sorted(names))]


def test_name_mapping(spark):
    ref = reference()
    a = [r for r in ref if r[1] == "a"]
    words = [r for r in a if r[2] == a[0][2]][0]
    other = next(r for r in ref if r[1] == "b" and all(r[2] != x[2] for x in a))
    name = words[2]
    entries = [(1, "a", name), (2, "a", f"【期間限定】 {name} ¥690"), (3, "a", unicodedata.normalize("NFKD", name)), (4, None, other[2]), (5, "b", "日替わり"), (6, "a", None), (7, "a", " ​"), (8, "zzz", name), (9, "a", name[:2] + name[3:] if len(name) > 9 else name), (1, "a", name), (None, "a", name)]
    df = spark.createDataFrame([(*e, "x") for e in entries], "entry_id bigint, chain string, name string, ref_id string")
    found = {r["entry_id"]: r["ref_id"] for r in name_mapping.map_names(df, spark.createDataFrame(ref, "ref_id bigint, chain string, canonical_name string, name string")).collect()}
    assert found == {1: words[0], 2: words[0], 3: words[0], 4: other[0], 5: -1, 6: -1, 7: -1, 8: -1, 9: words[0]}
    empty = name_mapping.map_names(df, spark.createDataFrame([], "ref_id bigint, chain string, canonical_name string"))
    assert {r["ref_id"] for r in empty.collect()} == {-1}


def test_ambiguous_names_mean_none(spark):
    heads, mids, ends = ("濃厚", "屋台風", "極旨", "贅沢"), ("チーズ", "バジル", "醤油", "海老"), ("カレー鍋", "うどん", "ピザ", "炒飯")
    names = [h + m + e for h in heads for m in mids for e in ends]
    ref = [(i, "a", n) for i, n in enumerate(names)] + [(100, "b", names[0])]
    entries = [(1, "a", names[0]), (2, None, names[0]), (3, None, names[1]), (4, "a", "チーズピザ"), (5, "a", names[0] + "大盛"), (6, "b", names[0])]
    found = name_mapping.map_names(spark.createDataFrame(entries, "entry_id bigint, chain string, name string"), spark.createDataFrame(ref, "ref_id bigint, chain string, canonical_name string"))
    assert {r["entry_id"]: r["ref_id"] for r in found.collect()} == {1: 0, 2: -1, 3: 1, 4: -1, 5: 0, 6: 100}


def test_components_are_learned_from_names(spark):
    rnd = random.Random(5)
    parts = [sorted({"".join(rnd.choice("あいうえおかきくけこさしすせそたちつてと") for _ in range(rnd.randint(2, 5))) for _ in range(16)}) for _ in range(3)]
    names = ["".join(rnd.choice(p) for p in parts) for _ in range(900)]
    learned = name_mapping.learn(spark.createDataFrame([(n,) for n in names], "name string"), first_share=5 / 900, share=15 / 900)
    words = {w for p in parts for w in p}
    assert len(words & set(learned.cost)) >= 0.9 * len(words)
    assert set(learned.weight) == {g for w in learned.cost for g in name_mapping.component_grams(w)}
    assert name_mapping.learn(spark.createDataFrame([], "name string")).cost == {}


def noisy(name, rnd, words, typos=1):
    """A name in another writing, misspelt, reordered, shortened or with additions."""
    t = name
    kind = rnd.choice(["width", "typo", "order", "short", "add", "same"])
    if kind == "typo":
        for _ in range(typos):
            i = rnd.randrange(1, len(t) - 1)
            t = t[:i] + rnd.choice([t[i + 1 :], t[i] + t[i:], t[i + 1] + t[i] + t[i + 2 :]])
    elif kind == "order":
        t = words[1] + words[0] + "".join(words[2:])
    elif kind == "short":
        t = "".join(words[1:])
    elif kind == "add":
        t = rnd.choice(["【期間限定】", "新発売!", ""]) + t + rnd.choice([" ※写真はイメージ", " 980円", ""])
    return unicodedata.normalize("NFKC", t)


def test_recall_and_precision_of_noisy_names(spark):
    rnd = random.Random(12)
    signs = [chr(c) for c in range(0x4E00, 0x4F80)] + [chr(c) for c in range(0x30A2, 0x30F0)]
    parts = [["".join(rnd.choice(signs) for _ in range(rnd.randint(2, 4))) for _ in range(30)] for _ in range(4)]
    items = {}
    while len(items) < 500:
        w = [rnd.choice(p) for p in parts]
        items.setdefault("".join(w), (len(items), rnd.choice("abcdefgh"), w))
    other_writing = {parts[2][0]: "ほかの書き方", parts[3][1]: "べつ"}  # two components that are also written otherwise
    entries, truth = [], {}
    for i in range(3000):
        name, (ref, chain, w) = rnd.choice(list(items.items()))
        if rnd.random() < 0.2:  # another dish of the same words
            k = rnd.randrange(4)
            w = [*w[:k], rnd.choice([x for x in parts[k] if x != w[k]]), *w[k + 1 :]]
            truth[i] = next((r for n, (r, c, _) in items.items() if n == "".join(w) and c == chain), -1)
            entries.append((i, chain, "".join(w)))
            continue
        truth[i] = ref
        typed = noisy(name, rnd, w)
        for a, b in other_writing.items():
            typed = typed.replace(a, b)
        entries.append((i, chain, typed))
    e = spark.createDataFrame(entries, "entry_id bigint, chain string, name string")
    r = spark.createDataFrame([(ref, chain, n) for n, (ref, chain, _) in items.items()], "ref_id bigint, chain string, canonical_name string")
    found = {x["entry_id"]: x["ref_id"] for x in name_mapping.map_names(e, r).collect()}
    told = [i for i in truth if found[i] != -1]
    assert sum(found[i] == truth[i] for i in told) >= 0.9 * len(told)
    meant = [i for i in truth if truth[i] != -1]
    assert sum(found[i] == truth[i] for i in meant) >= 0.9 * len(meant)


def test_prefixes_lose_no_pair_above_the_threshold(spark):
    ref = reference(7)
    language = name_mapping.learn(spark.createDataFrame([(name_mapping.fold(r[2]),) for r in ref], "name string"))
    rnd = random.Random(1)
    names = [name_mapping.fold(r[2]) for r in ref] + ["".join(rnd.choice(ref)[2][i : i + 3] for i in (0, 3, 6)) for _ in range(100)]
    rows = name_mapping._vectors(spark.createDataFrame([(n,) for n in set(names)], "k string"), "k", language, 0.7).collect()
    close = 0
    for a in rows:
        for b in rows:
            if sum(b["_parts"].get(i, 0) for i in a["_ids"]) >= 0.7 * a["_norm"] * b["_norm"]:
                close += 1
                assert set(a["_prefix"]) & set(b["_prefix"])
    assert close > len(rows)


def test_names_with_clashing_columns_and_of_any_length(spark):
    ref = spark.createDataFrame([(*r[:3], "x", 1) for r in reference()], "ref_id bigint, chain string, canonical_name string, name string, entry_id int")
    entries = [(1, "a", "あ" * 20_000, "k", 2), (2, "a", "", "k", 2), (3, None, None, "k", 2), (4, "a", next(r[2] for r in reference() if r[1] == "a"), "k", 2)]
    df = spark.createDataFrame(entries, "entry_id bigint, chain string, name string, _key string, score int")
    found = {r["entry_id"]: r["ref_id"] for r in name_mapping.map_names(df, ref).collect()}
    assert found == {1: -1, 2: -1, 3: -1, 4: next(r[0] for r in reference() if r[1] == "a")}
    assert name_mapping.map_names(df.limit(0), ref).count() == 0


def test_one_name_in_most_entries(spark):
    ref = spark.createDataFrame([r[:3] for r in reference()], "ref_id bigint, chain string, canonical_name string")
    hot = spark.range(5000).selectExpr("id as entry_id", "cast(null as string) as chain", f"'{reference()[0][2]}' as name")
    found = name_mapping.map_names(hot, ref)
    assert found.groupBy("ref_id").count().collect() == [(0, 5000)]


# --- the queries


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_queries_run(spark, name):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    df = llm.QUERIES[name](spark, folder)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_queries_equal_sql(spark, rows, name):
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("products", "duplicate_members", "source_trust"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    assert rows(llm.QUERIES[name](spark, folder)) == sorted(con.execute(llm.ORACLE_SQL[name]).fetchall(), key=lambda t: tuple((x is None, str(x)) for x in t))

"""Operators for training text against brute force, with nulls, blanks, ties, copies and extra columns."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import forms, leakage, levels, packing, repetition, runs, sentences

SEG = "video_id bigint, id bigint, start_s double, end_s double, text string, chunk string, skeleton string"


# --- 5: forms ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want", "why"),
    [
        ("Ｑｕｅｕｅ", "Queue", ["compatibility"]), ("𝖢𝖺𝖼𝗁𝖾", "Cache", ["compatibility"]), ("ﬁle", "file", ["compatibility"]), ("ﾌｧｲﾙ ｶﾞ", "ファイル ガ", ["compatibility"]), ("hình ①", "hình 1", ["compatibility"]),
        ("của", "của", ["decomposed"]), ("Khuê", "Khuê", ["decomposed"]), ("が", "が", ["decomposed"]), ("a​b", "ab", ["invisible"]), ("a b", "a b", ["space"]), ("あ　い", "あ い", ["space"]),
        ("Тidemark", "Tidemark", ["script"]), ("pоrt", "port", ["script"]), ("кнoпки", "кнопки", ["script"]), ("loոg", "long", ["script"]), ("dàі", "dài", ["decomposed", "script"]),
        ("main.cfgを開く", "main.cfgを開く", []), ("ทำงาน", "ทำงาน", []), ("ज़रूरी", "ज़रूरी", []), ("「はい、できます。」", "「はい、できます。」", []), ("“v1.2” … «да»", "“v1.2” … «да»", []), ("Новый файл", "Новый файл", []), ("", "", []), ("đường phố", "đường phố", []),
    ],
)
def test_forms(text, want, why):
    assert forms.reasons(text) == why
    assert forms.canonical(text) == want


def test_skeletons_meet():
    for a, b in (("Тidеmаrk", "Tidemark"), ("Ｑueue", "Queue"), ("của", "của"), ("a​ b", "a b"), ("раура", "paypa")):
        assert forms.skeleton(a) == forms.skeleton(b), a
    for t in ("Tidemark", "của", "файл", "ไทย", "ज़"):
        assert forms.skeleton(forms.skeleton(t)) == forms.skeleton(t)


def test_the_whole_table_of_confusables(spark):
    table = forms.confusables(spark)
    assert len(table) > 2000
    for a, b in (("l0ve", "lOve"), ("Ꭺpple", "Apple"), ("rn", "m"), ("сор", "cop"), ("ԛԝе", "qwe"), ("Ⅰ1l", "lIl"), ("вход", "bxoд"), ("ﬁle", "file"), ("ngừng", "ngừng")):
        assert forms.skeleton(a, table) == forms.skeleton(b, table), (a, b)
    for a, b in (("port", "part"), ("dài", "dai"), ("файл", "фаил")):
        assert forms.skeleton(a, table) != forms.skeleton(b, table), (a, b)
    # what a letter is resolved to inside a word of another script has its skeleton
    for i, own in enumerate(forms._to_script()):
        assert all(forms.skeleton(forms.canonical(c), table) == forms.skeleton(x, table) for c, x in own.items() if c == forms.canonical(c)), i


@pytest.mark.parametrize(
    ("kind", "texts"),
    [
        ("full-width", ["Ｑｕｅｕｅ", "Port２２", "ｶﾅ"]), ("compatibility", ["ﬁle", "𝖢𝖺𝖼𝗁𝖾", "Ⅳ", "x²"]), ("decomposed", ["cu\u0309a", "e\u0301tude", "か\u3099"]), ("singleton", ["\u212bngström", "10 \u212a"]),
        ("invisible", ["a\u200bb", "sha\u00addow", "x\ufeff", "ไทย\u200b"]), ("space", ["a\u00a0b", "あ\u3000い", "a\u2009b"]), ("script", ["pоrt", "Ꭺpple", "кнoпки", "Ρort", "loոg", "ріпe"]),
    ],
)
def test_planted_deviations(spark, kind, texts):
    df = spark.createDataFrame([(t, True) for t in texts] + [(forms.canonical(t), False) for t in texts] + [(t, False) for t in ("сор", "Ελλάδα", "“a…”", "東京Tower", "ngừng", "ज़रूरी", "ทำงาน", "naïve café", "10 µm"[:3], "l0ve")], "text string, odd boolean")
    got = [(r.text, r.odd, r.deviates) for r in forms.deviations(df).collect()]
    assert all(odd == deviates for _, odd, deviates in got), [g for g in got if g[1] != g[2]]


def test_deviations_and_groups(spark):
    rows = [(1, 0, 0.0, 1.0, t, "c", "s") for t in ("pоrt", "port", "port", None, "", "x" * 100_000)]
    df = spark.createDataFrame(rows, SEG)
    got = forms.deviations(df).select("text", F.size("reasons").alias("n"), "skeleton").collect()
    assert [r.n for r in got] == [1, 0, 0, 0, 0, 0] and got[3].skeleton is None and got[0].skeleton == "port"
    assert [tuple(r) for r in forms.same_looking(df).collect()] == [("port", 2, 3, 1)]
    assert forms.same_looking(df.limit(0)).count() == 0


# --- 1: repetition -------------------------------------------------------------------------------------------------


def brute_share(u):
    x, k, n = u.units, u.phrase, len(u.units)
    mark = set()
    for i in range(n - k + 1):
        if any(x[j : j + k] == x[i : i + k] for j in range(i - k + 1)):
            mark |= set(range(i, i + k))
    for unit in range(1, k):
        for i in range(n):
            times = 1
            while x[i + times * unit : i + (times + 1) * unit] == x[i : i + unit] and i + (times + 1) * unit <= n:
                times += 1
            if times >= repetition.TIMES:
                end = i + times * unit
                while end < n and x[end] == x[end - unit]:
                    end += 1
                mark |= set(range(i + unit, end))
    return sum(u.lengths[i] for i in mark) / u.total if u.total else 0.0


def test_repeated_shares_and_the_cascade():
    rng = random.Random(1)
    for _ in range(1500):
        if rng.random() < 0.5:
            text = " ".join(rng.choices(["ab", "c", "def", "g"], k=rng.randint(0, 16)))
        else:
            text = "".join(rng.choices("水火木", k=rng.randint(0, 24)))
        u = repetition.units_of(text)
        want = brute_share(u)
        assert repetition.exact_share(text) == pytest.approx(want), text
        for order in (["few", "new_units", "new_pairs"], ["new_pairs", "new_units", "few"]):
            got = repetition.share(text, order)
            assert (got is not None and got >= 0.5) == (want >= 0.5), text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("The plain disk checks a script. THE PLAIN, disk checks a script!", True), ("ja ja ja ja ja ja", True), ("ja ja ja nein", False), ("丸い電線は安い。丸い電線は安い。", False), ("丸い電線は安いボタン。丸い電線は安いボタン。", True),
        ("hãy đăng ký kênh, hãy đăng ký kênh", True), ("hãy đăng ký, hãy đăng ký", False), ("one two three four five six one two three four", False), ("", False), ("  ", False), (None, False),
    ],
)
def test_repetition_cases(spark, text, found):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, text, "", "")] * 2, SEG)
    assert repetition.repetitive(df, ["video_id", "id"]).count() == int(found)


def test_repetition_of_nothing_and_of_much(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, "a b c d " * 20_000, "", "")], SEG)
    assert repetition.repetitive(df, ["video_id", "id"]).first().repeated_share > 0.99
    assert repetition.repetitive(df.limit(0), ["video_id", "id"]).count() == 0


# --- 2: runs -------------------------------------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_within_is_edit_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
        for most in range(5):
            assert runs.within(a, b, most) == (edit(a, b) <= most)


@pytest.mark.parametrize(("a", "b", "want"), [("step3of14", "step4of14", False), ("abcdefghij", "abcdefghix", True), ("abcdefghi", "abcdefghx", False), ("x", "x", True)])
def test_same(a, b, want):
    assert runs.same(a, b) == want


def test_long_texts_are_bounded_first():
    rng = random.Random(14)
    for _ in range(40):
        a = "".join(rng.choices("abcdef", k=rng.randint(90, 200)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5)):
            b[rng.randrange(len(b))] = rng.choice("abcdef")
        b = "".join(b)
        assert runs.same(a, b) == (edit(a, b) <= int(max(len(a), len(b)) * runs.DIFFER + 1e-9))
    a, b = ("".join(rng.choices("abcdefghijklmnop", k=100_000)) for _ in range(2))
    began = time.perf_counter()
    assert not runs.same(a, b) and time.perf_counter() - began < 2


def test_runs_over_chunks(spark, monkeypatch):
    rng = random.Random(3)
    pool = ["The port is open", "the PORT is open!", "The pоrt is open", "Step 1 of 3", "Step 2 of 3", None, " ", "…"]
    texts = {v: [t for _ in range(60) for t in [rng.choice(pool)] * rng.choice([1, 1, 2, 5])] for v in (1, 2)}
    texts[3] = ["again and again"] * 2500
    rows = [(v, i + (i >= 70 and v == 2), float(i), None if i % 7 == 0 else i + 1.0, t, "clash", "") for v, x in texts.items() for i, t in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:50], SEG)
    want = set()
    for v in texts:
        mine = [(r[1], forms.letters_of(r[4] or "")) for r in rows if r[0] == v]
        first = 0
        for i in range(1, len(mine) + 1):
            if i < len(mine) and mine[i][0] == mine[i - 1][0] + 1 and mine[i][1] and mine[i - 1][1] and runs.same(mine[i - 1][1], mine[i][1]):
                continue
            if i - first > 1:
                want.add((v, mine[first][0], mine[i - 1][0], i - first))
            first = i
    got = runs.collapse(df)
    assert {(r.video_id, r.first_id, r.last_id, r.n_events) for r in got.collect()} == want
    whole = got.where("video_id = 3").first()
    assert (whole.first_id, whole.last_id, whole.n_events, whole.start_s, whole.end_s) == (0, 2499, 2500, 0.0, 2499.0)  # the last end is null
    assert runs.collapse(df.limit(0)).count() == 0


# --- 3: sentences --------------------------------------------------------------------------------------------------


def corpus():
    rng = random.Random(4)
    out = []
    nouns = ["server", "bucket", "screen", "folder", "ticket", "worker", "lesson", "picture"]
    for _ in range(3000):
        s = [f"The {rng.choice(nouns)} opens a {rng.choice(nouns)}{rng.choice('..!?')}" for _ in range(rng.choice([1, 1, 2, 3]))]
        if rng.random() < 0.3:
            s.insert(rng.randint(0, len(s)), rng.choice(["Dr. Ostrel set the limit, approx. 12 calls per minute.", "Use v4.5.7 of Tidemark, i.e. the stable build.", "“Is the port open?” the trainer asked.", "Read p. 12 of the lesson.", "We copy logs, images, etc."]))
        out.append(" ".join(s))
    for _ in range(500):
        out.append("".join(f"{rng.choice('長丸安')}い{rng.choice('箱窓鍵')}を{rng.choice('見開待')}ます。" for _ in range(rng.choice([1, 1, 2]))))
        out.append(" ".join(f"{rng.choice(['แฟ้ม', 'ภาพ'])}ใหม่{rng.choice(['ครับ', 'ค่ะ'])}" for _ in range(rng.choice([1, 1, 2]))))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return sentences.train(spark.createDataFrame([(t,) for t in corpus()] + [(None,), ("",)], "text string"))


@pytest.mark.parametrize(
    ("text", "begins"),
    [
        ("The server opens a bucket. The screen opens a folder.", [0, 27]), ("The server opens a bucket! the screen opens a folder", [0, 27]), ("Dr. Ostrel set the limit, approx. 12 calls per minute. The screen opens a folder.", [0, 55]),
        ("“Is the port open?” the trainer asked. The screen opens a bucket.", [0, 39]), ("Use v4.5.7 of Tidemark, i.e. the stable build. The worker opens a screen.", [0, 47]), ("no mark at all", [0]), ("one line\nanother line", [0, 9]),
        ("  The server (opens. It) a bucket.  The screen opens a folder.", [2, 36]), ("長い箱を見ます。丸い窓を開ます。", [0, 8]), ("แฟ้มใหม่ครับ ภาพใหม่ค่ะ", [0, 13]), ("แฟ้มใหม่คร\u200bับ ภาพใหม่ค่ะ", [0, 14]), ("…", [0]),
    ],
)
def test_boundaries(model, text, begins):
    assert model.begins([text, None, text]) == [begins, [], begins]


def test_sentences_of_awkward_rows(spark, model):
    rows = [(1, 0, 0.0, 1.0, "The server opens a bucket. The screen opens a folder. ", "", ""), (1, 1, 0.0, 1.0, None, "", ""), (1, 2, 0.0, 1.0, " \n ", "", "")]
    got = sentences.sentences(spark.createDataFrame(rows, SEG), ["video_id", "id"], model=model).orderBy("begin_char").collect()
    assert [(r.id, r.sentence_no, r.begin_char, r.end_char, r.sentence) for r in got] == [(0, 0, 0, 26, "The server opens a bucket."), (0, 1, 27, 53, "The screen opens a folder.")]
    assert sentences.sentences(spark.createDataFrame([], SEG), ["video_id", "id"]).count() == 0


def test_posteriors_are_those_of_all_paths(model):
    for line, unmarked in (("a. 8. b. 9. The server opens.", False), ("The server opens a bucket the screen opens", True), ("長い箱を見ます。丸い窓", False)):
        begins, hashes = sentences._tokens(line)
        g, got = model.posteriors([(begins, hashes, sentences.events(line))] * 3, unmarked)
        there, again, on = (w[: len(hashes)] for w in model.weights(g, unmarked))
        paths = {}
        for bits in range(1 << len(hashes)):
            state, p, before = [(bits >> i) & 1 for i in range(len(hashes))], 1.0, 0
            for i, s in enumerate(state):
                p *= (again[i] if before else there[i]) if s else (on[i] if before else 1.0)
                before = s
            paths[tuple(state)] = p
        all_ = sum(paths.values())
        want = [sum(p for s, p in paths.items() if s[i]) / all_ for i in range(len(hashes))]
        assert got.tolist() == pytest.approx(want * 3) and any(0 < x < 1 for x in want)


def test_posteriors_don_t_depend_on_the_lines_beside(model):
    rng = random.Random(10)
    weights = [np.exp(np.array([rng.gauss(0, 1) for _ in range(400)])) for _ in range(3)]
    at = np.array(sorted(rng.sample(range(1, 400), 30)))
    at = np.append(0, np.append(at, at[-1]))  # one line without events
    got = sentences.forward_backward(at, *weights, cells=64)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), 400]):
        if b > a:
            assert got[a:b].tolist() == pytest.approx(sentences.forward_backward(np.array([0]), *(w[a:b] for w in weights)).tolist())


def test_words_between_spaces_are_read_once(monkeypatch):
    """What training and scoring cost: a token is looked up for each new word, not for each word of all texts."""

    class Asked(sentences._Hashes):
        n = 0

        def __getitem__(self, token):
            Asked.n += 1
            return super().__getitem__(token)

    texts = [t for t in corpus() if t.isascii()]
    whole = sum(len(sentences._tokens(t)[1]) for t in texts)
    monkeypatch.setattr(sentences, "_HASHES", Asked())
    monkeypatch.setattr(sentences, "_CHUNKS", sentences._Chunks() if hasattr(sentences, "_Chunks") else None, raising=False)
    c = sentences.Counts()
    c.add(texts)
    c.put()
    sentences.Model(c.total, c.total.sum(1), c.lines).begins(texts)
    assert 0 < Asked.n < whole / 10


def test_short_ways_of_reading_lines_change_nothing():
    rng = random.Random(17)
    parts = [*".…。।”)“„ ", " ", " ", "\u200b", "\u3164", "a", "İ", "Σ", "о", "箱", "ค่ะ", "ครับ", "1", "12.5", "’", "word", "i.e.", "न", "\u0301", "x" * 70]
    full = sentences._patterns()
    for _ in range(20_000):
        line = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        if not line.strip():
            continue
        begins, hashes = sentences._tokens(line)
        assert sentences._hashes(sentences._low(line)) == hashes
        es = sentences.events(line)
        coarse, own = sentences._stretches(line, es)
        assert own == hashes and [sentences.bisect_left(coarse, e.begin) for e in es] == [sentences.bisect_left(begins, e.begin) for e in es], line
        # the places that the pattern for all kinds of lines finds
        found = full["event„" if "„" in line else "event"].finditer(line)
        wide = [m for m in found if m["p"] or m["w"] or m["m"][-1] in "。！？｡" or m["m"][-1] == "…" and any(sentences._CJK.match(line, k) for k in (m.start() - 1, m.end()))]
        assert [(e.at, e.begin) for e in es] == [(m.start(), m.end()) for m in wide if line[: m.start()].strip()], line
        m = full["end„" if "„" in line else "end"].search(line, max(0, len(line) - 40))
        got = sentences._ended(line)
        assert (got is None) == (not m or not m.start()), line
        assert got is None or got[1][0] == ("P" if m["p"] else sentences._mark(m["m"], False, False)), line


def test_counts_are_whole_however_they_are_put(monkeypatch):
    texts = corpus()
    want = sentences.Counts()
    want.add(texts)
    want.put()
    monkeypatch.setattr(sentences, "HELD", 2_000)
    got = sentences.Counts()
    for i in range(0, len(texts), 50):
        got.add(texts[i : i + 50])
        assert got.size + sum(map(len, got.marked)) <= 2_000
    got.put()
    assert (got.total == want.total).all() and (got.lines == want.lines).all() and not got.size


def test_boundaries_without_marks(spark):
    """Held-out texts with their marks taken out: the events between words alone must show most boundaries."""
    rng = random.Random(13)
    made = {
        "en": lambda: (f"{rng.choice(['the', 'this', 'our'])} {rng.choice(['server', 'screen', 'worker', 'lesson'])} {rng.choice(['opens', 'counts', 'sends'])} a {rng.choice(['bucket', 'folder', 'ticket'])}{rng.choice(['', ' today', ' again'])}", " ", "."),
        "th": lambda: (f"{rng.choice(['ตอนนี้', 'วันนี้'])}{rng.choice(['ผู้ใช้', 'เครื่อง'])}{rng.choice(['เปิด', 'ลบ'])}{rng.choice(['แฟ้ม', 'ภาพ'])}", " ", ""),
        "zh": lambda: (f"{rng.choice('今昨')}天{rng.choice('我你')}们{rng.choice('打看')}开{rng.choice('新旧')}{rng.choice('箱窗')}口", "", "。"),
        "hi": lambda: (f"{rng.choice(['यह', 'वह'])} {rng.choice(['सर्वर', 'पाठ'])} {rng.choice(['नया', 'पुराना'])} {rng.choice(['फ़ोल्डर', 'बक्सा'])} {rng.choice(['खोलता', 'गिनता'])} है", " ", "।"),
    }
    train = []
    for f in made.values():
        for _ in range(600):
            parts = [f() for _ in range(rng.choice([1, 1, 2]))]
            # a script without end marks shows its boundaries by line breaks alone
            train.append(((parts[0][1] if parts[0][2] else "\n").join(x + mark for x, _, mark in parts),))
    model = sentences.train(spark.createDataFrame(train, "text string"))
    for k, f in made.items():
        want, got, texts = [], [], []
        for _ in range(100):
            parts = [f() for _ in range(3)]
            gap = parts[0][1]
            texts.append(gap.join(p[0] for p in parts))
            begins = np.cumsum([0, *(len(p[0]) + len(gap) for p in parts)])[:-1].tolist()
            want.append(set(begins[1:]))
        got = [set(b[1:]) for b in model.begins(texts, unmarked=True)]
        hit = sum(len(a & b) for a, b in zip(got, want))
        recall, precision = hit / sum(map(len, want)), hit / max(1, sum(map(len, got)))
        print(k, "recall", round(recall, 3), "precision", round(precision, 3))
        assert recall > 0.9 and precision > 0.9, (k, recall, precision)
        # in text that has marks elsewhere, none of them ends a unit
        assert all(b == [0] for b in model.begins(texts))


# --- 8: packing ----------------------------------------------------------------------------------------------------


def test_pack_is_whole_and_tight():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([10, 64, 256])
        sizes = [min(capacity, max(1, int(rng.paretovariate(0.7)))) for _ in range(rng.randint(0, 200))]
        bins, n = packing.pack(sizes, capacity)
        load = np.bincount(bins, sizes, n) if sizes else np.zeros(0)
        assert (load <= capacity).all() and (load > 0).all() and len(bins) == len(sizes)
        large = [b for s, b in zip(sizes, bins) if 3 * s > capacity]
        assert max(np.bincount(large), default=0) <= 2
        assert n <= max(-(-sum(sizes) // capacity) * 1.25 + 1, sum(2 * s > capacity for s in sizes) + 1)


def test_assignments(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(["port", "bucket", "ổ đĩa", "窓"], k=rng.choice([1, 5, 40, 700]))), "x") for i in range(200)] + [(900, None, ""), (901, "", "")]
    docs += docs[:5]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, piece string")
    targets = spark.createDataFrame([(1, 64), (2, 1024), (2, 1024), (3, None), (4, 0)], "target_id bigint, capacity_tokens bigint")
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert sizes[0] == len(packing._encoding(packing.TOKENIZER).encode_ordinary(docs[0][1])) and 900 not in sizes and 901 not in sizes
    rows = packing.assign(df, targets, items_per_shard=50).collect()
    assert {r.target_id for r in rows} == {1, 2}
    for target, capacity in ((1, 64), (2, 1024)):
        load, own = {}, {}
        for r in rows:
            if r.target_id == target:
                load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
                own.setdefault(r.doc_id, {})[r.piece] = r.n_tokens
        assert max(load.values()) <= capacity
        assert {d: sum(p.values()) for d, p in own.items()} == sizes
        for d, p in own.items():
            assert len(p) == max(1, -(-sizes[d] // capacity)) and sorted(p) == list(range(len(p)))
    assert packing.assign(df, targets.limit(0)).count() == 0
    assert packing.fill(packing.assign(df, targets), targets).count() == 2


# --- 9: leakage ----------------------------------------------------------------------------------------------------


def brute_leak(item, doc):
    """Any stretch of the item from half of it on, laid on the document with one word in ten replaced."""
    a, b = leakage.tokens_of(item), leakage.tokens_of(doc)
    n = len(a)
    for d in range(-n, len(b) + 1):
        eq = [0 <= i + d < len(b) and a[i] == b[i + d] for i in range(n)]
        for i in range(n):
            if not eq[i]:
                continue
            for j in range(n, i, -1):
                if 2 * (j - i) < n or not eq[j - 1]:
                    continue
                if sum(not x for x in eq[i:j]) <= (j - i) * leakage.EXCHANGED + 1e-9:
                    return True
    return False


def test_leaks(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([24, 40, 60])))) for i in range(12)]
    docs = []
    for k in range(160):
        body = rng.choices(words, k=rng.randint(0, 120))
        _, text = rng.choice(items)
        w = text.split()
        size = int(len(w) * rng.choice([0.3, 0.45, 0.5, 0.55, 0.8, 1.0]))
        at = rng.randint(0, len(w) - size)
        passage = w[at : at + size]
        for i in rng.sample(range(size), int(size * rng.choice([0, 0.05, 0.1, 0.2]))):
            passage[i] = "other"
        where = rng.randint(0, len(body))
        docs.append((k, "  ".join(body[:where]) + ("\n" if where else "") + " ".join(x.upper() + rng.choice(["", ",", "."]) for x in passage) + " " + " ".join(body[where:])))
    want = {(i, k) for i, a in items for k, b in docs if brute_leak(a, b)}
    assert 30 < len(want) < 200
    extra = [(500, None), (501, ""), *docs[:10]]
    d = spark.createDataFrame([(*x, "clash") for x in docs + extra], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([*items, items[0], (77, None), (78, " ")], "item_id bigint, text string")
    got = [(r.item_id, r.doc_id) for r in leakage.leaks(d, e).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kept = {r.doc_id for r in leakage.without_leaks(d, e).collect()}
    assert kept == {x[0] for x in docs + extra} - {k for _, k in want}
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0


def test_leaks_in_small_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_TOKENS", 30)
    text = "今日は、古い報告を見ます。新しい鍵は速い組を待ちますから、長い列は短い箱を探します。"
    d = spark.createDataFrame([(1, "前" + text + "後"), (2, text[: len(text) // 3]), (3, "the quick port opens a green bucket today and then it closes again")], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, text), (2, "The quick port opens a green bucket today, and then it closes again.")], "item_id bigint, text string")
    assert {(r.item_id, r.doc_id) for r in leakage.leaks(d, e).collect()} == {(1, 1), (2, 3)}


def test_exchanged_words_of_other_lengths():
    a = "in this part the port shows a spare team before the break and the new picture keeps a plain list for the round user".split()
    b = "x y in this part the port shows a very spare team before the break and the picture keeps a plain list for the round user z".split()
    vocabulary = {w: i + 1 for i, w in enumerate(a)}
    item, doc = (np.array([vocabulary.get(w, 0) for w in x]) for x in (a, b))
    part, lo, hi = leakage._chain(item, np.ones(len(a)), doc, {2, 3})
    assert part == 1.0 and (lo, hi) == (2, len(b) - 1)


def streams(rng):
    items = [(i, [f"w{rng.randint(0, 5)}" for _ in range(rng.randint(1, 30))]) for i in range(rng.randint(1, 6))]
    docs = []
    for _ in range(rng.randint(1, 8)):
        words = [rng.choice([f"w{rng.randint(0, 7)}", "strange"]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            words += rng.choice(items)[1][: rng.randint(1, 30)] + ["strange"]
        docs.append(words)
    return items, docs + docs[: rng.randint(0, 2)]


def brute_matches(items, docs):
    """All maximal verbatim matches: (item, place in it, document, place in it, tokens)."""
    out = set()
    for i, a in items:
        for d, b in enumerate(docs):
            for q in range(len(a)):
                for p in range(len(b)):
                    if a[q] != b[p] or q and p and a[q - 1] == b[p - 1]:
                        continue
                    n = 0
                    while q + n < len(a) and p + n < len(b) and a[q + n] == b[p + n]:
                        n += 1
                    out.add((i, q, d, p, n))
    return out


def test_suffix_arrays_are_sorted_and_their_matches_those_of_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        items, docs = streams(rng)
        made = leakage.Items.of(items)
        m = leakage.Matcher(made)
        numbers = [np.array([made.vocabulary.get(w, 0) for w in d], np.int64) for d in docs]
        x, starts, ends = leakage._joined(numbers)
        array = m.array(x)

        def suffix(p, x=x, m=m):
            own = x[p : p + m.depth]
            zero = np.flatnonzero(own == 0)
            return own[: zero[0]].tolist() if len(zero) else own.tolist()

        own = [suffix(p) for p in array.places.tolist()]
        assert sorted(array.places.tolist()) == np.flatnonzero(x).tolist() and own == sorted(own)
        every = brute_matches(items, docs)
        place, p, n = m.matches(x)
        doc = np.searchsorted(starts, p, "right") - 1
        item = m.owner[place]
        got = list(zip(item.tolist(), (place - made.at[item]).tolist(), doc.tolist(), (p - starts[doc]).tolist(), n.tolist()))
        assert len(got) == len(set(got)) and set(got) == {e for e in every if e[4] >= made.seeds[e[0]]}
        place, p, n = m.longest(x)
        for q, length in zip(place.tolist(), n.tolist()):
            i = int(m.owner[q])
            at = q - int(made.at[i])
            tail = items[i][1][at:]
            # the longest start of this suffix that any document has
            texts = ["|" + "|".join(d) + "|" for d in docs]
            want = max((k for k in range(1, len(tail) + 1) if any("|" + "|".join(tail[:k]) + "|" in t for t in texts)), default=0)
            assert length == want


def test_longest_matches(spark):
    rng = random.Random(12)
    items, docs = streams(rng)
    d = spark.createDataFrame([(k, " ".join(w), "clash") for k, w in enumerate(docs)] + [(99, None, "")], "doc_id bigint, text string, n_tokens string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(50, "nowhere at all"), (51, None)], "item_id bigint, text string")
    got = {r.item_id: r.n_tokens for r in leakage.longest_matches(d, e).collect()}
    want = {}
    for i, _, _, _, n in brute_matches(items, docs):
        want[i] = max(want.get(i, 0), n)
    assert got == want
    for r in leakage.longest_matches(d, e).collect():
        words = dict(items)[r.item_id][r.item_token : r.item_token + r.n_tokens]
        assert docs[r.doc_id][r.doc_token : r.doc_token + r.n_tokens] == words
    assert leakage.longest_matches(d.limit(0), e).count() == 0 and leakage.longest_matches(d, e.limit(0)).count() == 0


# --- 10: levels ----------------------------------------------------------------------------------------------------


def test_reading_levels(spark):
    rng = random.Random(8)
    easy = ["port", "bucket", "green", "quick", "opens", "list", "new", "user"]
    hard = ["asynchronous", "topology", "probabilistic", "serialisability", "circumscribes", "idempotent", "orchestration", "granularity"]
    docs, true, grades = [], {}, []
    for i in range(600):
        level = rng.randint(1, 5)
        share = {1: 0.0, 2: 0.1, 3: 0.35, 4: 0.75, 5: 0.95}[level]
        docs.append((i, " ".join(rng.choice(hard if rng.random() < share else easy) for _ in range(120))))
        true[i] = level
        if rng.random() < 0.4:
            grades.append((i, min(5, max(1, level + rng.choice([0] * 8 + [-1, 1]))), "r", None))
    grades += [(0, None, "r", None), (9999, 5, "r", None), *grades[:20]]
    d = spark.createDataFrame([*docs, (700, None), (701, " "), docs[0]], "doc_id bigint, text string")
    g = spark.createDataFrame(grades, "doc_id bigint, level int, rater string, rated_at timestamp")
    got = {r.doc_id: r for r in levels.reading_levels(d, g).collect()}
    assert len(got) == 602 and got[700].level is None and not got[700].demanding
    wrong = sum(got[i].demanding != (true[i] >= 4) for i in true)
    assert wrong <= 12  # 98 % held right, mostly documents without a grade
    assert all(got[i].demanding == (got[i].level >= 4) for i in true)
    moved = [r.residual for r in levels.rounds(d, g).orderBy("round").collect()]
    assert moved[-1] <= levels.TOLERANCE < min(moved[:-1]) and len(moved) > 1
    with pytest.raises(ValueError, match="still move"):
        levels.propagate(levels.graph(d, g), most=1)
    none = levels.reading_levels(d, g.limit(0)).collect()
    assert all(r.level is None and not r.demanding for r in none)
    assert levels.reading_levels(d.limit(0), g).count() == 0


def test_levels_at_rest_are_harmonic(spark):
    """Every word is the mean of its documents, and every document that of its words on the grades' scale: at rest, one more
    round changes nothing, however it is computed."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdijkl" if rng.random() > (i % 5) / 5 else "efgh") for _ in range(30))) for i in range(80)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    grade = {i: 1 + i % 5 for i in range(80) if i % 4}
    g = spark.createDataFrame([(i, x, "r", None) for i, x in grade.items()], "doc_id bigint, level int, rater string, rated_at timestamp")
    words = levels.propagate(levels.graph(d, g))
    num, den = {}, {}
    for i, text in docs:
        own = [levels.zlib.crc32(w.encode()) & (levels.NODES - 1) for w in text.split()]
        weights = [words.weight[k] for k in own]
        mean = sum(w * words.level[k] for k, w in zip(own, weights)) / sum(weights)
        line = words.lines[0]
        level = grade.get(i, min(5.0, max(1.0, line[0] * mean + line[1])))
        for k in own:
            num[k], den[k] = num.get(k, 0) + level / len(own), den.get(k, 0) + 1 / len(own)
    assert len(words.residuals) > 1 and all(abs(num[k] / den[k] - words.level[k]) <= levels.TOLERANCE for k in num)


def test_every_share(spark):
    texts = ["a b c d a b c d", "a b c d e", "", None, "ja ja ja ja ja ja", "a b c d e f g h a b c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.repeated_share for r in repetition.with_every_share(df).collect()}
    want = {i: None if t is None else brute_share(repetition.units_of(t)) for i, t in enumerate(texts)}
    assert got == pytest.approx(want) and 0 < got[5] < 0.5


def test_more_targets_than_one_pass_takes(spark, monkeypatch):
    monkeypatch.setattr(packing, "TARGETS_AT_ONCE", 2)
    d = spark.createDataFrame([(i, "port " * (i + 1)) for i in range(20)], "doc_id bigint, text string")
    t = spark.createDataFrame([(k, 8 + k) for k in range(5)], "target_id bigint, capacity_tokens bigint")
    got = packing.assign(d, t)
    assert got.groupBy("target_id").agg(F.countDistinct("doc_id").alias("n")).where("n = 20").count() == 5

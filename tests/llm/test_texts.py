import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from covertrace.llm import abuse, encodings, leakage, packing
from covertrace.llm.fold import fold, sentences

# -- encodings

SOUND = [
    ("en", "The union in Vellabury denied the report; shares fell 4 percent, the court said on Monday. “Nobody signed,” the buyer said. "), ("da", "Havnen i Rosnogård registrerede rødspætter og ål på kajen, før auktionen åbnede. Ingen køber vil sige hvorfor. "),
    ("de", "Im Hafen wurden gegerbte Häute gezählt, während Lastwagen warteten. Der Prüfer überprüfte die Bücher für März. "), ("es", "El puerto pesó más toneladas según la nómina; la acción cayó después. Ningún químico habló de la licitación en España. "),
    ("fr", "À Corigård, l’action a cédé après l’enquête. Le délégué a contesté la fiche de paie à la fin de l’été. "),
]


@pytest.fixture(scope="module")
def restorer():
    known = encodings.Dictionaries({lang: (text * 30).encode() for lang, text in SOUND})
    known.words = frozenset(w.strip("., ;“”’") for _, text in SOUND for w in text.lower().split())
    return encodings.Restorer(known)


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp1251")]


@pytest.mark.parametrize("true,read", CHAINS)
def test_round_trip_of_wrong_decodings(restorer, true, read):
    for language, text in SOUND[1:4]:
        garbled = text.encode(true).decode(read, "replace")
        if garbled == text or "�" in garbled:
            continue
        damaged, restored, chains = restorer.restore(garbled)
        assert damaged and restored == text, (language, chains)


def test_twice_and_in_part(restorer):
    text = SOUND[1][1]
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert restorer.restore(twice)[1] == text
    part = text + text.encode().decode("cp1252") + text
    assert restorer.restore(part)[:2] == (True, text * 3)


def test_sound_texts_stay(restorer):
    for text in [t for _, t in SOUND] + ["Café Ãngstrøm™ © 2021 — ¿quién? ¡nadie! § 12 ¶ 3, 20 °C", "«SÃO PEDRO» e «A NAÇÃO» assinaram", "Файл «Ђорђе»; Łódź, İzmir", "½ ¾ ¼.", "日本語のテキスト", "", None]:
        assert restorer.restore(text) == (False, text, "")


ELSEWHERE = {
    "ru": "Правительство приняло решение о новых правилах. Порт закрыт до понедельника.", "pl": "Zażółć gęślą jaźń. Rząd przyjął nowe przepisy w sprawie portów i statków.",
    "el": "Η κυβέρνηση αποφάσισε νέους κανόνες για το λιμάνι.", "tr": "Hükümet liman için yeni kurallar açıkladı. Işık ve gölge dışında çalışıyor.", "zh": "政府宣布了新的港口规定，人们对此不满。茅台酒很贵。",
    "ja": "東京の港は閉鎖されました。", "cs": "Vláda přijala nová pravidla pro přístav.",
}


@pytest.mark.parametrize("text", [*ELSEWHERE.values(), "See https://x.example/list?page=2 for the report.", "The file is at x.example/a?page=2&b=ø today.", "The harbour was closed, why?because the union in the report said so on Monday."])
def test_sound_texts_of_other_languages_and_addresses_stay(restorer, text):
    assert restorer.restore(text) == (False, text, "")


@pytest.mark.parametrize("language,read", [(x, r) for x in ("ru", "pl", "el", "tr") for r in ("cp1252", "cp1253", "koi8_r", "cp1256", "cp1257", "cp1251")] + [("tr", "shift_jis")])
def test_utf8_read_in_other_encodings(restorer, language, read):
    try:
        garbled = ELSEWHERE[language].encode().decode(read)
    except UnicodeDecodeError:
        pytest.skip("no such reading")
    assert restorer.restore(garbled)[:2] == (True, ELSEWHERE[language])


@pytest.mark.parametrize("read", ["cp1253", "koi8_r", "cp1256", "cp1257", "gbk", "big5", "shift_jis"])
def test_western_text_in_utf8_read_in_other_encodings(restorer, read):
    text = "The harbour café was closed because the Müller report said naïve things."
    try:
        garbled = text.encode().decode(read)
    except UnicodeDecodeError:
        pytest.skip("no such reading")
    assert restorer.restore(garbled)[:2] == (True, text)


@pytest.mark.parametrize("language,true", [("ru", "cp1251"), ("ru", "koi8_r"), ("pl", "cp1250"), ("el", "cp1253")])
def test_other_scripts_read_as_a_western_encoding(restorer, language, true):
    damaged, restored, chains = restorer.restore(ELSEWHERE[language].encode(true).decode("latin_1"))
    assert damaged and restored == ELSEWHERE[language] and chains.endswith(f">{true}")


def test_lost_letters_count(restorer):
    assert restorer.restore("r�kobolt fra havnen")[0] and restorer.restore("r?kobolt fra havnen")[0] and not restorer.restore("Why? Because.")[0]


def test_a_reading_is_weighed_once(restorer, monkeypatch):
    weighed = []

    class Counted:
        def __init__(self, language, compressor):
            self.language, self.compressor = language, compressor

        def compress(self, data):
            weighed.append((self.language, data))
            return self.compressor.compress(data)

    monkeypatch.setattr(restorer.weigher, "compressors", {lang: Counted(lang, c) for lang, c in restorer.weigher.compressors.items()})
    for right, wrong in CHAINS:
        damaged = SOUND[1][1].encode(right).decode(wrong, "replace")
        weighed.clear()
        assert restorer.restore(damaged)[0] and weighed and len(weighed) == len(set(weighed))
    weighed.clear()
    # sound in itself, in whatever language it is
    assert not restorer.restore("The card reads Северный порт, she said.")[0] and not weighed


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aéÃ¸\x80\x9f\xa0“ЖяΩ漢あ�\ud800")))
def test_bytes_are_those_of_each_character(text):
    for encoding in (*encodings.READ_AS, *encodings.READ_AS_TOO, *encodings.READ_AS_DOUBLE, "latin_1"):
        each = [ch.encode(encoding, "ignore") or (ch.encode("latin_1") if "\x80" <= ch < "\xa0" else None) for ch in text]
        assert encodings.to_bytes(text, encoding) == (None if None in each else b"".join(each))


def test_damaged_fields(spark):
    data = [(i, t, lang, t * 3, "x") for i, (lang, t) in enumerate(SOUND * 3)] + [(90, SOUND[1][1].encode().decode("cp1252"), "da", None, "x"), (91, None, None, "f�r", "x")]
    df = spark.createDataFrame(data, "id long, headline string, language string, body_text string, restored string")
    assert rows(encodings.damaged_fields(df), "article_id", "field_name") == [(90, "headline"), (91, "body_text")]
    assert encodings.damaged_fields(df.limit(0)).count() == 0


def test_every_sound_text_counts_in_the_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(encodings, "DICTIONARY_TEXTS", 4)
    monkeypatch.setattr(encodings, "BLOCKS", 2)
    named = lambda k: "".join(chr(97 + int(c)) for c in str(1000 + k))
    data = [(k, "da", f"{SOUND[1][1]} Fartøjet {named(k)} hejste flaget {named(k)}. {SOUND[1][1]}") for k in range(40)]
    found = encodings.train_dictionaries(spark.createDataFrame(data, "id long, language string, body_text string"))
    assert set(found) == {"da"} and "Fartøjet".encode() in found["da"]
    # each name stands in one of 40 texts, less than one of four, whichever texts come first
    assert {"fartøjet", "auktionen"} <= found.words and not found.words & {named(k) for k in range(40)}


def test_dictionaries_tell_sound_texts_in_the_workers(spark, monkeypatch):
    plans, write = [], encodings.written
    monkeypatch.setattr(encodings, "written", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    damaged = SOUND[1][1].encode().decode("cp1252")
    data = [(k, "da", f"{SOUND[1][1] * 2} Kajplads{'xyz'[k % 3]}") for k in range(6)] + [(k, "da", damaged * 3 + " Strandgods") for k in range(6, 12)] + [(12, "fr", damaged * 3)]
    found = encodings.train_dictionaries(spark.createDataFrame(data, "id long, language string, body_text string"))
    # the JVM takes many times as long over the pattern
    assert plans and not any("RLIKE" in plan for plan in plans)
    assert set(found) == {"da"} and "strandgods" not in found.words and {"kajpladsx", "kajpladsz"} <= found.words


def test_no_text_is_kept_aside_when_a_dictionary_is_trained():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000)]
    samples = [" ".join([*(rng.choice(words) for _ in range(120)), *["which only later texts hold by heart"] * (i >= 600)]).encode() for i in range(800)]
    assert b"later texts hold" in encodings._trained(samples)
    few = [b"the first of few " + bytes([65 + i]) * 40_000 for i in range(3)]
    assert all(text in encodings._trained(few) for text in few)


# -- packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 120))
def test_packing_loses_and_overfills_nothing(sizes, capacity):
    windows = packing.pack(sizes, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= capacity for w in windows)
    assert len(windows) <= max(0, 2 * -(-sum(sizes) // capacity))


def brute_difference(sizes, k):
    import heapq

    heap = [(-s, i, [0] * (k - 1) + [s]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(x + y for x, y in zip(sorted(a), sorted(b, reverse=True)))
        heapq.heappush(heap, (merged[0] - merged[-1], tie, merged))
        tie += 1
    return heap[0][2]


def test_differencing_equals_whole_tuples():
    rng = random.Random(1)
    for _ in range(200):
        sizes, k = [rng.randint(1, 50) for _ in range(rng.randint(1, 40))], rng.randint(1, 12)
        assert max(w[0] for w in packing.difference(sizes, k)) == max(brute_difference(sizes, k))


def test_packed_documents(spark):
    rng = random.Random(4)
    texts = ["word " * rng.choice((3, 50, 400, 1500)) for _ in range(60)] + [None, "", "<|endoftext|>", "long " * 9000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, window_id string")
    encode = packing.encoding(packing.VOCABULARY).encode_ordinary
    got = packing.packed(df, 1024).collect()
    for i, t in enumerate(texts):
        pieces = sorted((r.first_token, r.n_tokens) for r in got if r.doc_id == i)
        n = len(encode(t)) if t else 0
        assert pieces == [(a, min(1024, n - a)) for a in range(0, n, 1024)]
    used = {}
    for r in got:
        used[r.window_id] = used.get(r.window_id, 0) + r.n_tokens
    assert max(used.values()) <= 1024 and sum(used.values()) / (1024 * len(used)) > 0.9
    assert packing.window_report(df, 1024).count() == len(used)
    assert packing.packed(df.limit(0)).count() == 0


# -- leakage

PASSAGE = ["Ysum Watch counted 4,263 crew and 20 minors aboard the FV Odamia.", "Records from Vellabury show soy meal prices at $19.3 million, up 19 percent since July 2020.", "No inspector in Rosnogård would say who rerouted the tender for squid.", "Letters dated 3 May 2019 tie Elkorø Cosmetics to a mislabelled permit in Solrivik."]
ITEMS = [(1, " ".join(PASSAGE), "How many crew did Ysum Watch count aboard the FV Odamia?", "4,263", "x"), (2, "Another passage about a wholly different matter stands here. It has a second sentence as well.", None, None, "x"), (3, None, None, None, "x")]
FILL = "The committee met in spring and discussed the budget for roads. "


def leaks(spark, *texts):
    documents = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, passage string, question string, answer string, doc_id string")
    return rows(leakage.leaked(documents, items))


def test_leaks(spark):
    html = "".join(f"<p>{s.replace('crew', '<b>crew</b>')}</p>" for s in PASSAGE)
    texts = [
        FILL + " ".join(PASSAGE) + FILL, " ".join(PASSAGE[::-1]), FILL * 30 + PASSAGE[3] + FILL + PASSAGE[0], PASSAGE[1] + FILL, html, " ".join(PASSAGE).upper().replace(" ", " "),
        "> " + " ".join(PASSAGE).replace(" and ", "\n> and "), " ".join(PASSAGE).replace("counted", "listed").replace("show", "reveal").replace("rerouted", "moved"), ITEMS[0][2] + " 4,263", ITEMS[0][2] + " 99 of them", "How many crew did Ysum Watch count aboard the FV Other? 812",
        FILL, None, "",
    ]
    assert leaks(spark, *texts) == [(i, 1) for i in sorted((0, 1, 2, 4, 5, 6, 7, 8), key=str)]


def test_an_altered_word_in_a_short_question(spark):
    items = spark.createDataFrame([(1, None, "Who signed the secret permit for the harbour?", "Olga", "x")], "item_id long, passage string, question string, answer string, doc_id string")
    documents = spark.createDataFrame([(1, FILL + "Who signed the hidden permit for the harbour? Olga did.", "x"), (2, "Who signed the permit? Olga did.", "x")], "doc_id long, text string, item_id string")
    assert rows(leakage.leaked(documents, items)) == [(1, 1)]


def test_many_items_of_many_words_in_one_pass_over_the_corpus(spark):
    held = [(k, " ".join(f"w{k}x{j}" for j in range(60)) + ".", None, None) for k in range(2100)]  # 126,000 words
    items = spark.createDataFrame(held, "item_id long, passage string, question string, answer string")
    documents = spark.createDataFrame([(k, FILL + held[k][1]) for k in range(0, 2100, 300)], "doc_id long, text string")
    seeds = leakage.prepared_items(items).mapInPandas(leakage._item_seeds, "seed long, item long, part int, n_seeds int")
    keyed = documents.selectExpr("doc_id as doc", "text")
    assert leakage.candidate_pairs(keyed, seeds)._jdf.queryExecution().optimizedPlan().toString().count("emit(") == 1
    assert rows(leakage.leaked(documents, items)) == sorted([(k, k) for k in range(0, 2100, 300)], key=str)


def test_few_bits_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_BITS", 1)
    assert leaks(spark, " ".join(PASSAGE), ITEMS[1][1], FILL) == [(0, 1), (1, 2)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25))
def test_tiles_are_common_runs_that_overlap_nowhere(p, d):
    tiles = leakage.tile(p, d, leakage.running(p, 3), leakage.running(d, 3))
    seen_p, seen_d = set(), set()
    for i, j, n in tiles:
        assert p[i : i + n] == d[j : j + n] and n >= 3
        assert not seen_p & set(range(i, i + n)) and not seen_d & set(range(j, j + n))
        seen_p |= set(range(i, i + n))
        seen_d |= set(range(j, j + n))
    longest = max((k for k in range(3, 26) for i in range(len(p) - k + 1) for j in range(len(d) - k + 1) if p[i : i + k] == d[j : j + k]), default=0)
    assert max((n for _, _, n in tiles), default=0) == longest


def test_folding():
    assert fold("Cаfé &amp; <b>Bjørn</b> 4,263\nwei-\nter") == "cafe &  bjorn  4263\nweiter"
    assert sentences("Am 3. Mai. Dann?\n\nJa") == ["Am 3. Mai.", "Dann?", "Ja"] and sentences(None) == []


# -- abuse

HARMLESS = ["The port logged 19 tonnes of squid in May.", "Thanks, that part was news to me.", "Wrong again: the figure is 20, look it up.", "The breeder registered one bitch and two dogs.", "Havnen registrerede 12 ton ål.", "Das Gericht verhandelt am 3. Mai über den Vertrag."]
INSULTS = ["You worthless idiot, go hang yourself.", "Shut up, you disgusting pig.", "Typical scumbag, too brainless to read.", "Halt die Fresse, du Arschloch.", "Hold kæft, dit dumme svin.", "Cállate, cabrón, y púdrete."]


def test_learns_from_votes_on_whole_documents_and_reads_disguises():
    rng = random.Random(9)
    documents = []
    for k in range(300):
        own = [rng.choice(HARMLESS) for _ in range(8)]
        if k % 3 == 0:
            own[rng.randrange(8)] = rng.choice(INSULTS)
        documents.append(("\n".join(f"user{j}: {s}" for j, s in enumerate(own)), int(k % 3 == 0) if k % 20 else 1 - int(k % 3 == 0)))
    scorer = abuse.Scorer(*abuse.train(documents))
    bad = ["Fine day.\nYou w0rthless idiiiiiot, go hang yourself.", "shut up you d.i.s.g.u.s.t.i.n.g pig", "YOU DISGUSTING PІG, SHUT UP"]
    good = ["\n".join(HARMLESS), "The breeder registered one bitch and two dogs.", "", None]
    assert min(s for s, _ in scorer.scores(bad)) >= abuse.THRESHOLD > max(s for s, _ in scorer.scores(good))
    assert scorer.scores([None, ""]) == [(0.0, ""), (0.0, "")]


def test_abuse_tables(spark):
    texts = HARMLESS * 10 + INSULTS * 5 + [None, ""]
    d = spark.createDataFrame([(i, t, "s" if i % 2 else None, 3) for i, t in enumerate(texts)], "doc_id long, text string, source string, score int")
    votes = spark.createDataFrame([(i, "r", int(60 <= i < 90), datetime(2020, 1, 1)) for i in range(90) if i % 5 < 2] + [(0, "q", None, None), (None, "q", 1, None), (1, "a", 1, None), (1, "b", 0, None)], "doc_id long, reviewer string, abusive int, reviewed_at timestamp")
    found = {r.doc_id for r in abuse.abusive_documents(d, votes).collect()}
    assert len(found & set(range(60, 90))) >= 27 and len(found - set(range(60, 90))) <= 3
    assert abuse.abuse_scores(d, votes).count() == len(texts)
    assert {r.source for r in abuse.source_rates(d, votes).collect()} == {None, "s"}
    assert abuse.abusive_documents(d.limit(0), votes.limit(0)).count() == 0

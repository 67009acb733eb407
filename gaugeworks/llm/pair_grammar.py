"""General language for the pair classifier: refusals, foreign statements, void texts and their look-alikes.

Nothing here is taken from a table. Refusals come from a small grammar, foreign statements from function words and the
vocabulary of text criticism put together at random, so what is learnt is the language and not a sentence.
`(a|b|)` is a choice, `{thing}` the name of a tool, `{topic}` a few words, `{class}` a word of a class.
"""

import random
import re

#: English words of declining and judging, by class; `x*` stands for every word that begins with x.
WORDS: dict[str, str] = {
    "self": "i i'm i've i'd i'll me my myself we we're our us",
    "model": "ai assistant model chatbot system program bot machine",
    "cannot": "cannot can't couldn't won't unable refuse* declin* wouldn't mustn't shouldn't impossible reject* forb* prohibit* prevent* disallow* abstain* withhold* unwilling incapable skip pass",
    "not": "not no never neither nor without don't doesn't isn't aren't nothing none",
    "allow": "allow* permit* able permission authori* willing comfortable supposed capable ability position free qualified",
    "judge": "rate rating ratings rated evaluat* assess* judg* score scores scored scoring review reviewing grade grading opinion* verdict* critique* mark* comment*",
    "assist": "help assist* answer* comply complied respond* reply provide* providing offer* fulfil* continue engage* discuss* process produce give giving proceed share",
    "sorry": "sorry apolog* unfortunately regret* afraid pardon excuse",
    "policy": "policy policies guideline* safety rules rule restrict* sensitive inappropriate unsafe harmful violat* terms ethic* instructions instructed against compliance filter blocked flagged responsible beyond outside",
    "request": "request* question* task prompt content material topic subject this that",
    "text": "description text sentence wording documentation docstring phrase paragraph name parameter* argument* example* limit* purpose tool function return* caller* reader* user*",
    "value": "clear clearly unclear vague precise specific explicit* implicit* missing lacks lacking complete incomplete short brief long good poor weak strong useful helpful understandable ambiguous redundant obvious states says mentions explains describes names repeats covers tells omits",
}
CLASSES = ["", *WORDS]

REFUSALS = [
    "({sorry_|}i|{sorry_|}we) (cannot|can't|will not|won't|am unable to|am not able to|refuse to|decline to|must decline to|have to decline to|am not permitted to|am not allowed to) {do} (this|that|{thing}|the tool|such content|the {topic}|anything about {topic})( {why}|)",
    "as (an ai|an ai model|an assistant|a language model|an automated reviewer|a machine)(,|) i (cannot|can't|do not|am unable to|am not able to|have no way to) {do} (this|tools|content|opinions|the {topic}|{thing})( {why}|)",
    "{sorry} (but |) (i|we) (cannot|can't|won't|am unable to|am not able to|must not) {do} (this|that|{thing}|this one|the request)( {why}|)", "(my|our|the) (policy|guidelines|instructions|rules|safety rules) (do not allow|don't allow|forbid|prevent|prohibit|stop) (me|us) (to {do}|from {doing}|{doing}) (this|{thing}|such tools|the {topic})",
    "(this|the) (request|content|material|topic|tool|description|subject) (is against|violates|breaks|conflicts with|goes beyond|falls outside) (my|our|the) (policy|policies|guidelines|rules|terms|remit)(,| and| so) (i|we) (will not|cannot|won't|can't) {do} it", "(no|not any) (rating|score|evaluation|judgement|opinion|answer) (can|will|may) be (given|provided|offered|issued)( for {thing}| on {topic}| here|)( {why}|)",
    "(i|we) (prefer|choose|would rather|would prefer) not to {do} (this|{thing}|the {topic}|it)( {why}|)", "(i|we) (do not|don't) (feel comfortable|think it is right|consider it appropriate|have permission) (to {do}|{doing}) (this|{thing}|such material|the {topic})", "(request|evaluation|rating|assessment|answer) (declined|refused|denied|blocked|rejected|withheld)( {why}| for {thing}|)( by the safety system|)", "{doing} (this|{thing}|such content|the {topic}) (is not something|is nothing) (i|we) (can|will|may|am allowed to|am willing to) do",
    "(please|kindly) (ask|contact|consult) (a human|someone else|another reviewer|an expert)(,| because| as) (i|we) (cannot|can't|won't) {do} (this|{thing})", "(i|we) (have|need) to (refuse|pass|abstain|stop here|skip this)(,| because| since) (this|the {topic}|{thing}) (is|concerns|touches) (a restricted|a sensitive|an unsafe|a forbidden) (topic|subject|area)", "it (is|would be) (not appropriate|inappropriate|unsafe|irresponsible|against my rules) (for me |) to {do} (this|{thing}|the {topic})",
    "(i|we) (was|were) (told|instructed|asked) not to {do} (such|this kind of|these) (content|tools|material|requests)", "(unable|not able|not allowed|not permitted) to {do} (this|{thing}|the request)( {why}|)", "(let us|let's|can we) (talk about|turn to|discuss) something else( instead|)(,|;|) (i|we) (cannot|won't|can't) {do} (this|{thing})", "(i|we) (will not|won't) be {doing} (this|{thing}|that|the {topic})", "(i|we) (lack|do not have) the (ability|permission|authority|right) to {do} (this|{thing}|the {topic})",
    "{sorry}(,|) (this|that|{topic}) (is|seems|looks like) (something|a request|a topic|a task|nothing) (i|we) (cannot|can't|won't|may not) (help|assist|deal|engage) with", "{sorry}(,| but) {doing} (this|that|{topic}|{thing}|such content) (is|would be|goes) (outside|beyond|against) (my|our|the) (policy|guidelines|limits|role|rules|instructions)( {why}|)", "(i|we) (cannot|can't|will not|may not|am not going to) {do} (the |this |)(description|tool|text|material) (because|as|since|;) (my|our) (guidelines|rules|policy|instructions) (forbid|do not allow|don't allow|rule out|exclude) (it|this|that)", "(cannot|can't|unable to|will not) (help|assist|comply|continue|answer)(:|.| -|,) (policy|safety|restricted|sensitive|unsafe) (reason|request|topic|content|material)", "(this|the) (request|topic|content|{topic}) (is|falls) (under|within|inside) (a restricted|a sensitive|an unsafe) (policy|area|category)(,|;| and) (no|not any) (rating|score|review) of the (text|description|tool) (is|will be|can be) (given|made|offered)",
    "{sorry}(,| about that,| about this,) (i|we) (do not|won't|have decided not to|must refuse to|am going to have to decline to) {do} (this|that|{thing}|the {topic}|your request)", "{sorry}(,|) (but |)(the |this |that |your |)(request|question|topic|task) (is one|is something) (i|we) (must|have to) (refuse|decline|turn down|leave)", "(scoring|rating|judging) (of |)(content|material|tools|text) (about|on|with|like) ({topic}|{thing}) (is|was) (declined|refused|blocked|not permitted|not allowed)( by (policy|the guidelines|safety rules)|)", "(for|out of) (safety|policy|ethical) (reasons|concerns)(,|) (i|we) (decline|refuse|choose not|am not able) to {do} (this|{thing}|the text)", "(that|this) (goes|is) against (what i am allowed to do|my instructions|my policy|the rules i follow)(,| and|;) (i|we) (leave|must leave|will leave) (it|the score|the rating) (out|open|blank)",
    "(thank you|thanks)(,| for asking,) but (i|we) (must|have to|need to) (decline|refuse|pass|leave this unanswered)", "{doing} (third-party|such|these|external) (tools|software|systems) is (outside|beyond) (my|our) (abilities|scope|role|remit)",
]
_DO = "rate|evaluate|assess|judge|score|review|grade|comment on|answer|help with|assist with|comply with|discuss|process|give an opinion on|provide a rating for|fulfil"
_DOING = "rating|evaluating|assessing|judging|scoring|reviewing|grading|commenting on|answering|discussing|processing|giving an opinion on"
_WHY = "because of policy|due to safety rules|as it concerns {topic}|since it is restricted|for safety reasons|because it may cause harm|under my guidelines|as the content is sensitive|because the subject is restricted"
_SORRY = "sorry|i am sorry|i'm sorry|i apologise|my apologies|unfortunately|regrettably|i'm afraid|i regret"

#: Judgements that share words with refusals.
SOUND = [
    "(i|we) (cannot|can't|could not) (tell|see|find|guess) (what|why|how|when) (it|the tool|{thing}) (does|returns|changes|is for)(,| so the score is low|)", "the (description|text) (cannot|can't) be (rated|scored|judged) (higher|better) (because|as|since) (it|the purpose) (is vague|says nothing about {topic})", "the (tool|function|description) (does not|won't|will not|cannot) (say|explain|mention|handle|process|allow) (the {topic}|what it returns|limits)", "(unfortunately|sadly)(,|) the (purpose|text|description) (is|stays|remains) (vague|unclear|implicit)",
    "(it|the text) (says|states|explains) that {thing} (refuses|rejects|declines|blocks) (requests|calls|input) (without|about|for) {topic}", "(a|the) (reader|caller|user|model) (cannot|can't|is unable to|is not able to) (know|decide|tell) (when|whether|why) to (call|use) {thing}", "(i|we) (rate|rated|score|give) (it|this|{thing}) (low|high|three|four) because (the|its) (purpose|aim) is (clear|vague|named)", "(no|without) (limits|examples|context|parameters) (are|is) (given|mentioned|stated)(,| but the purpose is clear|)", "the (policy|rules|permission) (tool|check|setting) is (clearly|well|poorly) (named|described|explained)", "(my|the) (rating|score|judgement) (is|would be) (higher|lower) if (it|the text) (named|mentioned) {topic}", "nothing is (said|stated) about (safety|permissions|what is not allowed)", "(very|quite|rather|too|fairly|reasonably|) {value}", "{value} {text}", "{text} {value}", "(well|badly|nicely|poorly|clearly) (stated|written|phrased|described|put|worded)", "(good|poor|weak|strong|decent|solid|fair) (text|wording|summary|purpose|statement)", "(purpose|aim|goal) (is|) (clear|unclear|stated|vague)( enough|)",
]

#: Placeholders that stand for no statement.
_VOID_MARKS = ["", " ", "-", "--", ".", "..", "...", "…", "?", "*", "_", "{}", "[]", '""', "''", "()", "/", "#", "n/a", "na", "none", "null", "nil", "nan", "undefined", "empty", "blank", "tbd", "todo", "not applicable", "not available", "not provided", "unknown"]
_VOID_FORMS = ["(no|without|missing) (reasoning|comment|explanation|answer|justification|rationale|response|text|reason|statement|output)( given| provided| available| found| returned| recorded|)"]

#: Common function words by language.
FUNCTION_WORDS = {k: frozenset(v.split()) for k, v in {
    "en": "the a an of to in is are it its and or but that this what which who when where how why for with without by as at on from be been was were not no yet so than then one two both can could would should will may might does do did has have had there only also if any some all more most into out up about i you we they he she very too just even still while because after before each every other such these those here",
    "de": "der die das und ist nicht ein eine den dem des zu mit von auf für aber man sich es nur aus ohne wenn wann dass daher im sein wird bleibt was wie oder auch noch durch bei nach über wurde werden kann sehr zum zur sind einen einer einem keine kein hat haben dieser diese dieses",
    "es": "el la los las de que y es en un una no se por con para su lo pero sin aunque cuando sobre nada solo del al como más o si ya muy este esta esto qué cuál fue son está hay también porque cada entre desde hasta",
    "pt": "o a os as de que e em um uma não nao se por com para seu sua mas sem quando sobre apenas da do na no ao porem porém é são foi ou mais muito este esta isso isto qual também como já pelo pela dos das há cada entre até",
    "fr": "le la les de des et est un une ne pas que qui ce dans pour par sur mais sans car au aux du il elle ou plus très cette ces son sa ses se sont être comme aussi où quand ni avec on leur entre chaque",
    "it": "il lo la gli le di che è un una non si per con ma del della dei quando nel più e o sono anche come questo questa molto senza cui dal dalla sul alla alle ai ogni tra quale perché",
    "nl": "de het een en van is niet op te dat die voor met maar geen aan uit wanneer ook als bij naar er wordt zijn was dit deze heel zonder om door over wel nog",
    "pl": "i w nie na z do się jest to że o jak ale brak tylko dla co jako oraz przez ten ta te są był bez po od gdy czy bardzo także który która które",
    "ru": "и в не на что с по но из как это для лишь нет а о от к за то же или так только при без если его она они был была очень также который которая",
    "sv": "och att det i en är inte på som för med men av den ett till om har från kan utan när också bara eller mycket",
    "da": "og at det i en er ikke på som for med men af den et til om har fra kan uden når også kun eller meget",
    "fi": "ja on ei se että mutta kun vain tai myös joka ovat ilman sen hyvin niin jos kuin",
    "ro": "și de la în nu cu este că pe dar un o sau mai foarte care pentru din sunt fără când doar",
    "cs": "a je ale to na se že z pro jen v s do jsou nebo jak bez kdy velmi také který která",
    "hu": "a az és nem egy hogy is de csak ez vagy van mint nagyon nélkül mikor már",
    "tr": "ve bir bu için ancak ile de da yalnızca ama gibi daha çok ne değil olarak kadar her var yok",
    "uk": "і в не на що з по але із як це для лише та або також без якщо дуже який яка",
    "el": "και το η ο να δεν είναι με για από που στο των την αλλά μόνο ως ή πολύ χωρίς",
    "vi": "và của là không có một cho được với các những này khi nhưng để trong ra đã rất chỉ",
    "id": "dan yang di ini itu tidak dengan untuk dari pada adalah atau juga hanya tanpa ketika sangat oleh",
}.items()}

#: The vocabulary of text criticism, and of scripts that are written without spaces.
_TOPIC_WORDS = {
    "de": "Beschreibung Zweck Werkzeug klar unklar Beispiel fehlt nennt erklärt deutlich knapp Text Angabe Parameter Grenze versteht genau Note Leser Ergebnis",
    "es": "descripción propósito herramienta claro ejemplo falta indica explica breve texto parámetros límite entiende nota resultado objetivo lector vago detalla",
    "pt": "descrição propósito ferramenta claro exemplo falta indica explica curto texto parâmetros limite entende nota resultado objetivo leitor vago detalha",
    "fr": "description objectif outil clair exemple manque indique explique court texte paramètres limite comprend note résultat but lecteur vague précise",
    "it": "descrizione scopo strumento chiaro esempio manca indica spiega breve testo parametri limite capisce voto risultato lettore vago precisa",
    "nl": "beschrijving doel gereedschap duidelijk voorbeeld ontbreekt noemt legt kort tekst grens begrijpt score resultaat lezer vaag",
    "pl": "opis cel narzędzie jasny przykład brakuje podaje wyjaśnia krótki tekst parametry granica rozumie ocena wynik czytelnik niejasny",
    "ru": "описание цель инструмент ясно пример отсутствует указывает объясняет кратко текст параметры предел понятно оценка результат читатель неясно",
    "sv": "beskrivning syfte verktyg tydligt exempel saknas anger förklarar kort text gräns förstår betyg resultat läsare vag",
    "da": "beskrivelse formål værktøj tydeligt eksempel mangler angiver forklarer kort tekst grænse forstår resultat læser vag",
    "fi": "kuvaus tarkoitus työkalu selvä esimerkki puuttuu kertoo selittää lyhyt teksti raja ymmärtää tulos lukija epäselvä",
    "ro": "descriere scop instrument clar exemplu lipsește indică explică scurt text limită înțelege notă rezultat cititor vag",
    "cs": "popis účel nástroj jasný příklad chybí uvádí vysvětluje krátký text mez rozumí známka výsledek čtenář nejasný",
    "hu": "leírás cél eszköz világos példa hiányzik jelzi magyarázza rövid szöveg határ érthető eredmény olvasó homályos",
    "tr": "açıklama amaç araç açık örnek eksik belirtiyor anlatıyor kısa metin sınır anlaşılır puan sonuç okuyucu belirsiz",
    "uk": "опис мета інструмент ясно приклад відсутній вказує пояснює короткий текст межа зрозуміло оцінка результат читач",
    "el": "περιγραφή σκοπός εργαλείο σαφής παράδειγμα λείπει δηλώνει εξηγεί σύντομο κείμενο όριο αποτέλεσμα",
    "vi": "mô tả mục đích công cụ rõ ràng ví dụ thiếu nêu giải thích ngắn văn bản giới hạn kết quả",
    "id": "deskripsi tujuan alat jelas contoh kurang menyebutkan menjelaskan singkat teks batas hasil pembaca kabur",
    "zh": "描述 目的 工具 清楚 例子 缺少 说明 解释 简短 文本 参数 限制 理解 分数 结果 读者 模糊 但是 没有 的 了 这个 所以 不 很 是 只 何时 使用",
    "ja": "説明 目的 ツール 明確 例 不足 述べ 短い 文章 引数 制限 理解 点数 結果 読者 曖昧 しかし です ます が は を に の ない この ため だけ",
    "ko": "설명 목적은 도구의 명확하다 예시가 부족하다 말한다 짧은 문장 인자 제한을 이해 점수 결과 독자 모호하다 그러나 없다 이 하지만 때문에",
    "ar": "الوصف الغرض الأداة واضح مثال ناقص يذكر يشرح قصير النص المعاملات الحد يفهم الدرجة النتيجة القارئ غامض لكن لا في من هذا على متى",
    "he": "התיאור המטרה הכלי ברור דוגמה חסר מציין מסביר קצר הטקסט הגבול מובן הציון אבל לא של על זה מתי",
    "hi": "विवरण उद्देश्य उपकरण स्पष्ट उदाहरण कमी बताता समझाता छोटा पाठ सीमा अंक परिणाम लेकिन नहीं है का की में यह कब",
    "th": "คำอธิบาย วัตถุประสงค์ เครื่องมือ ชัดเจน ตัวอย่าง ขาด ระบุ สั้น ข้อความ ขอบเขต ผลลัพธ์ แต่ ไม่ ที่ ของ นี้ เมื่อ",
}
LANGUAGES = sorted(set(_TOPIC_WORDS))

_CHOICE = re.compile(r"\(([^()]*)\)")
_SLOT = re.compile(r"\{(\w+_?)\}")


def expand(pattern: str, rng: random.Random, things: list[str], topics: list[str]) -> str:
    """One sentence of a pattern, with names and phrases of the texts at hand."""
    pattern = pattern.replace("{sorry_|}", f"{rng.choice(_SORRY.split('|'))}, " if rng.random() < 0.3 else "")
    while "(" in pattern:
        pattern = _CHOICE.sub(lambda m: rng.choice(m.group(1).split("|")), pattern)
    lists = {"do": _DO, "doing": _DOING, "why": _WHY, "sorry": _SORRY, "value": "|".join(w for w in WORDS["value"].split() if w[-1] != "*"), "text": "|".join(w for w in WORDS["text"].split() if w[-1] != "*")}
    for _ in range(3):
        pattern = _SLOT.sub(lambda m: rng.choice(lists[m.group(1)].split("|")) if m.group(1) in lists else f"`{rng.choice(things)}`" if m.group(1) == "thing" else rng.choice(topics), pattern)
    text = " ".join(pattern.split())
    return text[:1].upper() + text[1:] + rng.choice([".", ".", ".", "", "!"])


def void(rng: random.Random) -> str:
    s = rng.choice(_VOID_MARKS)
    if rng.random() < 0.5:
        s = rng.choice(_VOID_FORMS)
        while "(" in s:
            s = _CHOICE.sub(lambda m: rng.choice(m.group(1).split("|")), s)
    s = rng.choice([s, s, s.upper(), s.capitalize()])
    return rng.choice(["{}", "{}", "{}.", "({})", "<{}>", "[{}]"]).format(s) if s.strip() else s


def foreign(lang: str, rng: random.Random, things: list[str]) -> str:
    """A statement of a language: its function words and the vocabulary of text criticism in random order."""
    topic = _TOPIC_WORDS[lang].split()
    own = sorted(FUNCTION_WORDS.get(lang, ()))
    spaced = lang not in ("zh", "ja", "th")
    ws = [rng.choice(own) if own and rng.random() < 0.55 else f"`{rng.choice(things)}`" if rng.random() < 0.08 else rng.choice(topic) for _ in range(rng.randint(3, 16))]
    if len(ws) > 8 and rng.random() < 0.6:
        ws[len(ws) // 2] += "," if spaced else "，"
    text = (" " if spaced else "").join(ws)
    if rng.random() < 0.2:
        import unicodedata

        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)) if lang in ("es", "pt", "fr", "it", "ro", "cs", "pl") else text
    return text[:1].upper() + text[1:] + rng.choice([".", ".", ""] if spaced else ["。", "。", ""])

"""Text normalisers, detectors and parsers as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
IRREGULAR = {"people": "person", "men": "man", "women": "woman", "children": "child", "mice": "mouse", "geese": "goose", "teeth": "tooth", "feet": "foot", "buses": "bus", "lenses": "lens"}
UNTOUCHED_OBJECTS = ["glasses", "sunglasses", "eyeglasses", "goggles", "pants", "jeans", "trousers", "shorts", "scissors", "binoculars", "pliers", "clothes", "stairs", "news", "series", "species"]
UNTOUCHED_TOKENS = ["this", "yes", "his", "hers", "ours", "yours", "theirs", "its", "thus", *UNTOUCHED_OBJECTS]
CUE_ALIASES = {
    "television": "tv", "television set": "tv", "tv monitor": "tv", "cellphone": "cell phone", "mobile phone": "cell phone",
    "aeroplane": "airplane", "air plane": "airplane", "motorbike": "motorcycle", "motor bike": "motorcycle",
}
NUMBER_WORDS = {
    "zero": "0", "none": "0", "no": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
}
AUXILIARIES = ["is", "are", "was", "were", "do", "does", "did", "can", "could", "will", "would", "should", "has", "have", "had"]
YESNO_OR_STARTS = ["are there any ", "can you see any ", "do you see any ", "does the image show any ", "is there any "]
REGION_START = "please provide a short description for this region:"
BOX_START = "please provide the bounding box coordinate of the region this sentence describes:"
LEADING_WORDS = ["the", "this", "that", "these", "those", "it", "there", "he", "she", "they", "we", "i"]
BAD_LAST_WORDS = ["a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "do", "does", "did"]
BAD_ANSWERS = [
    "", "There are", "There is", "It is", "He is", "She is", "They are", "We are", "He does", "She does", "It does", "They do", "We do", "I do",
    "In the image,", "It is not visible,", "Yes, there is a", "Yes, there is an", "Yes, there are", "No, there is no", "No, there are no", "The bathtub is",
]
MORE_BAD_ANSWERS = [
    "Buick, land rover, ford, chrysler, kia, subaru,", "Jacket, snow pants, gloves,", "Red, blue, beige, black, yellow, pink, green,", "That breed does",
    "Doesn't want to", "Nobody wants to", "Can carry around with", "I don't know who person is", "To put bike on", "Picture was played with",
]
READING_PATTERN = (
    "(^|[^a-z0-9_])(ocr|read (the )?text|text in (the )?(image|picture|photo)|what does .* say|what is written|written on"
    "|transcribe|transcription|words? on|letters? on|license plate)([^a-z0-9_]|$)|识别|读出|文字|文本|写着|写的内容|牌子上|看清字"
)
IMAGE_PATTERN = "<image>|(^|[^a-z0-9_])(image|picture|photo|photograph|scene|visible|shown)([^a-z0-9_]|$)|图中|图片|照片|画面|这张图|这幅图"
BAD_PHRASES = ["the answer is", "in the image", "are you", "again,", "an answer", "the last one"]
RETRY_ANSWERS = ["no image", "unknown", "image not available", "unable to determine"]
# Words without their apostrophe, or with one in the wrong place, as answers are compared.
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't",
    "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't", "hed": "he'd", "hed've": "he'd've",
    "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't", "itd": "it'd",
    "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've",
    "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at",
    "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll",
    "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's",
    "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd",
    "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've",
    "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't",
    "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd",
    "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't",
    "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're",
    "youve": "you've",
}
ANSWER_MARKS = [';', '/', '[', ']', '"', '{', '}', '(', ')', '=', '+', '\\', '_', '-', '>', '<', '@', '`', ',', '?', '!']
ARTICLES = ["a", "an", "the"]
BLANKS = r"[ \t\n\x0b\f\r]+"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key], key)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")


def normalized(text: Column) -> Column:
    """Without image marks, with single spaces and none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<image>", " "), BLANKS, " "))


def normalized_answer(text: Column) -> Column:
    return F.lower(normalized(text))


def singular(token: Column, untouched: list[str]) -> Column:
    """A plural made singular: irregular ones by a list, then by the first suffix that fits."""
    n, drop = F.length(token), lambda k: token.substr(F.lit(1), F.length(token) - k)
    regular = (
        F.when(token.endswith("ies") & (n > 4), F.concat(drop(3), F.lit("y")))
        .when(token.endswith("ives") & (n > 4), F.concat(drop(3), F.lit("fe")))
        .when(token.endswith("ves") & (n > 4), F.concat(drop(3), F.lit("f")))
        .when(token.rlike("(sses|ches|shes|xes|zes)$") & (n > 4), drop(2))
        .when(token.endswith("es") & (n > 4), drop(1))
        .when(token.endswith("s") & ~token.rlike("(ss|us|is|es)$"), drop(1))
        .otherwise(token)
    )
    return F.when(token.isin(*IRREGULAR), _lookup(IRREGULAR, token)).when(token.isin(*untouched) | (n <= 3), token).otherwise(regular)


def question_tokens(text: Column) -> Column:
    """The lower-case words and numbers of a question, singular, without lone s."""
    found = F.regexp_extract_all(normalized_answer(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(found, lambda t: t != "s"), lambda t: singular(t, UNTOUCHED_TOKENS))


def visual_cue(text: Column) -> Column:
    """An object's name: separators and marks as spaces, no leading article, aliases, last word singular."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(normalized_answer(text), r"[_\-/]+", " "), r"[^a-z0-9 \t\n\x0b\f\r]+", " "), BLANKS, " "))
    bare = let(F.regexp_replace(plain, "^(a|an|the) ", ""), lambda x: _lookup(CUE_ALIASES, x))
    last = lambda x: F.element_at(F.split(x, " "), -1)
    joined = let(bare, lambda x: F.concat(x.substr(F.lit(1), F.length(x) - F.length(last(x))), let(last(x), lambda w: singular(w, UNTOUCHED_OBJECTS))))
    return let(joined, lambda x: _lookup(CUE_ALIASES, x))


def answer_tokens(text: Column) -> Column:
    """Lower-case words with inner apostrophes, number words as digits and numbers without leading zeros."""
    found = F.regexp_extract_all(F.lower(normalized(text)), F.lit("[a-z0-9]+('[a-z0-9]+)?"), F.lit(0))
    number = lambda t: F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(_lookup(NUMBER_WORDS, t))
    return F.transform(found, number)


def question_family(text: Column) -> Column:
    return F.when(text.startswith(BOX_START), "bbox_coord").when(text.startswith(REGION_START), "region_desc").otherwise("other")


def question_type(text: Column) -> Column:
    """Kind of a normalised lower-case question, by the first rule that fits."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    has = lambda word: padded.contains(f" {word} ")
    starts = lambda words: _any([text.startswith(w) for w in words])
    first = F.get(F.regexp_extract_all(text, F.lit("[a-z0-9]+('[a-z0-9]+)?"), F.lit(0)), F.lit(0))
    plain_yesno = has("either") | starts(YESNO_OR_STARTS) | (starts(["is there ", "are there ", "do you see ", "can you see "]) & has("any"))
    return (
        F.when(text.startswith("where ") | has("position") | has("located"), "location")
        .when(starts(["can you ", "could you ", "would you "]), "other")
        .when(first.isin(*AUXILIARIES), F.when(has("or") & ~plain_yesno, "choice").otherwise("yesno"))
        .when(has("or"), "choice")
        .when(text.startswith("how many") | has("number"), "count")
        .when(has("color") | has("colour"), "color")
        .when(has("room"), "room")
        .when(has("material") | has("made of"), "material")
        .otherwise("other")
    )


def answer_type(given: Column, answer: Column) -> Column:
    """The given type unless empty or unknown, else what the answer looks like."""
    own, text = F.lower(trimmed(F.coalesce(given, F.lit("")))), F.lower(trimmed(F.coalesce(answer, F.lit(""))))
    looks = F.when(text.isin("yes", "no", "true", "false"), "yes/no").when(text.rlike("^[0-9]+$"), "number").when(text != "", "other").otherwise("unknown")
    return F.when((own != "") & (own != "unknown"), own).otherwise(looks)


def is_reading_text(text: Column) -> Column:
    return F.lower(text).rlike(READING_PATTERN)


def mentions_image(text: Column) -> Column:
    return F.lower(text).rlike(IMAGE_PATTERN)


def is_truncated(answer: Column, aggressive: bool = False) -> Column:
    """Whether an answer breaks off: a known stump, a comma at the end, or few words that end on a bad one."""
    text = trimmed(answer)
    words = F.split(text, BLANKS)
    bare = lambda w: F.regexp_replace(F.lower(w), "^[,.;:!?\"']+|[,.;:!?\"']+$", "")
    first, last = bare(F.element_at(words, 1)), bare(F.element_at(words, -1))
    short = F.size(words).between(2, 8) & ~text.rlike("[.!?]$")
    stump = last.isin(*ARTICLES) | (first.isin(*LEADING_WORDS) & last.isin(*BAD_LAST_WORDS))
    known = BAD_ANSWERS + (MORE_BAD_ANSWERS if aggressive else [])
    return text.isin(*known) | text.endswith(",") | (short & stump)


def looks_bad(answer: Column) -> Column:
    """Phrases, line breaks, long numbers or brackets that an answer shouldn't have; never for an empty one."""
    text = trimmed(answer)
    number = F.regexp_replace(text, BLANKS, "").rlike("^[0-9]{5,}$")
    return (text != "") & (_any([F.lower(text).contains(p) for p in BAD_PHRASES]) | text.contains("\n") | number | text.rlike(r"[{}\[\]|\\]"))


def needs_retry(answer: Column, finish: Column) -> Column:
    text = F.lower(trimmed(answer))
    return (text == "") | text.isin(*RETRY_ANSWERS) | ((F.lower(finish) == "length") & (F.size(F.split(text, BLANKS)) <= 2))


def yes_no_words(text: Column) -> Column:
    """First sentence without commas: no if it has the word no or not in any case, else yes."""
    words = F.split(F.lower(F.regexp_replace(F.substring_index(trimmed(text), ".", 1), ",", "")), BLANKS)
    return F.when(F.arrays_overlap(words, F.array(F.lit("no"), F.lit("not"))), "no").otherwise("yes")


def yes_no_exact_words(text: Column) -> Column:
    """As ``yes_no_words``, but only for No, not and no, between single spaces."""
    words = F.split(F.regexp_replace(F.substring_index(text, ".", 1), ",", ""), " ")
    return F.when(F.arrays_overlap(words, F.array(F.lit("No"), F.lit("not"), F.lit("no"))), "no").otherwise("yes")


def yes_no_contained(label: Column, text: Column) -> Column:
    """Whether the lower-case answer contains its label: TP, FN, TN or FP; null for other labels."""
    lower = F.lower(text)
    return F.when(label == "yes", F.when(lower.contains("yes"), "TP").otherwise("FN")).when(label == "no", F.when(lower.contains("no"), "TN").otherwise("FP"))


def yes_no_lenient(text: Column) -> Column:
    """yes or no by what is contained, then by the first word's first letter, else invalid."""
    lower = F.lower(text)
    first = trimmed(lower)
    return (
        F.when(lower.contains("yes"), "yes").when(lower.contains("no"), "no").when(first.startswith("y"), "yes").when(first.startswith("n"), "no").otherwise("invalid")
    )


def is_yes_no(text: Column) -> Column:
    return F.lower(trimmed(text)).isin("yes", "no")


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as sets; 0 if either is empty or they share nothing."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared > 0, 2.0 * shared / (F.size(a) + F.size(b))).otherwise(0.0)


def after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def image_file(image_id: Column) -> Column:
    return F.format_string("COCO_train2014_%012d.jpg", image_id)


def first_filled(*columns: Column) -> Column:
    """The first column that isn't null or blank."""
    return F.coalesce(*[F.nullif(trimmed(c), F.lit("")) for c in columns])


def choice_letter(text: Column, letters: list[str]) -> Column:
    """The letter itself, the letter of "X. ", or the only "The answer is X."; else FAILED."""
    named = F.regexp_extract_all(text, F.lit("The answer is ([A-Z])."), F.lit(1))
    return (
        F.when(text.isin(*letters), text)
        .when((F.length(text) >= 3) & F.substring(text, 1, 1).isin(*letters) & (F.substring(text, 2, 2) == ". "), F.substring(text, 1, 1))
        .when(F.size(named) == 1, F.get(named, F.lit(0)))
        .otherwise("FAILED")
    )


def score_pair(review: Column) -> Column:
    """Two numbers of the first line, between spaces or commas; (-1, -1) for anything else."""
    parts = F.split(F.regexp_replace(F.substring_index(review, "\n", 1), ",", " "), " ")
    a, b = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    none = F.array(F.lit(-1.0), F.lit(-1.0))
    return F.when((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(), F.array(a, b)).otherwise(none)


def is_nullish(text: Column) -> Column:
    return text.isNull() | F.lower(text).isin("nan", "none")


def plain_answer(text: Column) -> Column:
    """Lower case, without marks and articles, number words as digits and contractions with their apostrophes, as answers are compared in evaluation."""
    low = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[,?]", ""), "'s", " 's")), "[\n\t]", " "))
    out = low
    for mark in ANSWER_MARKS:
        near = low.contains(mark + " ") | low.contains(" " + mark)
        out = F.replace(out, F.lit(mark), F.when(near, "").otherwise(" "))
    words = F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(out, r"\.(?![0-9])", ""), BLANKS, " ")), " "), lambda w: ~w.isin(*ARTICLES, ""))
    numbers = {k: v for k, v in NUMBER_WORDS.items() if k not in ("no", "eleven", "twelve")}
    return F.array_join(F.transform(words, lambda w: _lookup(numbers | CONTRACTIONS, w)), " ")


def prompt_question(prompt: Column) -> Column:
    """The lower-case question of a prompt of one of four layouts; null for any other."""
    lines = F.split(prompt, "\n")
    tokens_first = F.regexp_extract(prompt, "(?s)Question: (.*?) Short answer:", 1)
    three = prompt.contains("Reference OCR token: ") & (F.size(lines) == 3)
    found = (
        F.when(prompt.startswith("OCR tokens: "), tokens_first)
        .when(three & prompt.startswith("Reference OCR token:"), F.get(lines, F.lit(1)))
        .when(three | (F.size(lines) == 2), F.get(lines, F.lit(0)))
    )
    return F.lower(found)


def tagged_answer(text: Column) -> Column:
    """What stands between the first answer tags, or the whole text; without blanks at the ends."""
    inner = F.regexp_extract(text, "<answer>(.*?)</answer>", 1)
    return trimmed(F.when(text.rlike("<answer>.*?</answer>"), inner).otherwise(text))


def exact_reward(completion: Column, solution: Column) -> Column:
    return (tagged_answer(completion) == tagged_answer(solution)).cast("double")


def format_reward(completion: Column) -> Column:
    """1 if a text starts with thoughts and an answer, each in its tags on one line, else 0."""
    return completion.rlike(r"^<think>.*?</think>[ \t\n\x0b\f\r]*<answer>.*?</answer>").cast("double")


def dataset_of(path: Column, has_question: Column, has_answer: Column) -> Column:
    """gqa or vg by an image's path, else vqa for a row with a question and an answer."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.when(low.rlike("masked_images/gqa|/gqa/"), "gqa").when(low.rlike("masked_images/vg|/vg/|visual_genome"), "vg").when(has_question & has_answer, "vqa")


def dataset_of_generated(path: Column, generated: Column, question: Column) -> Column:
    """As ``dataset_of`` with two more paths; vqa only where no question was generated."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(low.rlike("masked_images/gqa|masked_results_gqa|/gqa/"), "gqa").when(low.rlike("masked_images/vg|masked_results_vg|/vg/|visual_genome"), "vg").when(generated.isNull() & question.isNotNull(), "vqa")
    )


def mask_quality(coverage: Column, share: Column, area: Column) -> Column:
    return F.when((coverage >= 0.5) & (share >= 0.15) & (area <= 0.6), "strong").when((coverage >= 0.2) & (share >= 0.03) & (area <= 0.75), "partial").otherwise("weak")

"""Word lists, part-of-speech order and weights that annotation rules refer to."""

# Parts of speech, in the order that breaks ties, and their token priorities.
POS_ORDER = ["v", "n", "adj", "adv", "aux", "modal", "pron", "det", "prep", "conj", "x"]
PRIORITY = {"det": 0.74, "pron": 0.76, "prep": 0.7, "conj": 0.68, "aux": 0.78, "modal": 0.78, "n": 0.85, "v": 0.88, "adj": 0.82, "adv": 0.8, "x": 0.1}
OPEN_CLASS = ["n", "v", "adj", "adv"]
CLOSED_CLASS = ["det", "pron", "prep", "conj", "aux", "modal"]

# Closed-class English words.
CLOSED_WORDS = {
    "det": "a an the this that these those each every some any no",
    "pron": "i me my mine we us our ours you your yours he him his she her hers it its they them their theirs who whom whose which what",
    "prep": "in on at to from for with without by of about under over between through during before after into onto across",
    "conj": "and or but nor yet so because although though while if unless when where whether",
    "aux": "am is are was were be been being have has had do does did",
    "modal": "can could may might must shall should will would",
}

# Common English words.
COMMON_WORDS = {
    "adj": "quick slow happy sad good bad new old large small clear important basic local remote",
    "adv": "very quite rather also already still now then here there often always never",
    "v": "run runs learn learns study studies read reads write writes make makes use uses show shows mark marks work works need needs",
    "n": "language word words sentence sentences system learning story stories model models page pages color colors label labels",
}

#: Suffix rules in order: pattern, shortest length, part of speech, confidence.
SUFFIX_RULES = [
    ("ly$", 4, "adv", 0.82),
    ("(ing|ed|en|ify|ise|ize)$", 5, "v", 0.76),
    ("(ous|ful|able|ible|al|ive|ic|less|ary|ent|ant)$", 5, "adj", 0.72),
    ("(tion|sion|ment|ness|ity|ism|ist)$", 5, "n", 0.72),
]


def rule_words() -> list[tuple[str, str, float]]:
    """word, pos, confidence of both lists; a word in two lists keeps its first."""
    found: dict = {}
    for table, confidence in ((CLOSED_WORDS, 0.99), (COMMON_WORDS, 0.92)):
        for pos, words in table.items():
            for word in words.split():
                found.setdefault(word, (word, pos, confidence))
    return list(found.values())

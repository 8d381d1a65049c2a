"""Fixed tables of the language: suffixes, grammar rules, proper nouns, script exceptions, word priors."""

from __future__ import annotations

# Id, Cyrillic form, Latin form, category, what it attaches to, order (1 is next to the root).
SUFFIXES = [
    ("PL", "лар", "lar", "plural", "noun|adjective", 2),
    ("GEN", "нинг", "ning", "case_genitive", "noun", 3),
    ("DAT_GA", "га", "ga", "case_dative", "noun", 3),
    ("DAT_KA", "ка", "ka", "case_dative", "noun", 3),
    ("DAT_QA", "қа", "qa", "case_dative", "noun", 3),
    ("ACC", "ни", "ni", "case_accusative", "noun", 3),
    ("LOC_DA", "да", "da", "case_locative", "noun", 3),
    ("LOC_TA", "та", "ta", "case_locative", "noun", 3),
    ("ABL_DAN", "дан", "dan", "case_ablative", "noun", 3),
    ("ABL_TAN", "тан", "tan", "case_ablative", "noun", 3),
    ("POSS_1S", "им", "im", "possessive", "noun", 1),
    ("POSS_2S", "инг", "ing", "possessive", "noun", 1),
    ("POSS_3S", "и", "i", "possessive", "noun", 1),
    ("POSS_3S_SI", "си", "si", "possessive", "noun", 1),
    ("POSS_1P", "имиз", "imiz", "possessive", "noun", 1),
    ("POSS_2P", "ингиз", "ingiz", "possessive", "noun", 1),
    ("V_INF", "моқ", "moq", "verb_tense", "verb", 4),
    ("V_PRES", "а", "a", "verb_tense", "verb", 4),
    ("V_PRES_Y", "й", "y", "verb_tense", "verb", 4),
    ("V_FOCAL", "яп", "yap", "verb_tense", "verb", 4),
    ("V_PROG", "моқда", "moqda", "verb_tense", "verb", 4),
    ("V_PPERF", "ган", "gan", "verb_tense", "verb", 4),
    ("V_PAST", "ди", "di", "verb_tense", "verb", 4),
    ("V_IND_PAST", "иб", "ib", "verb_tense", "verb", 4),
    ("V_FUT", "ажак", "ajak", "verb_tense", "verb", 4),
    ("V_OBL_FUT", "адиган", "adigan", "verb_tense", "verb", 4),
    ("V_COND", "са", "sa", "verb_tense", "verb", 4),
    ("V_INT", "моқчи", "moqchi", "verb_tense", "verb", 4),
    ("V_NEG", "ма", "ma", "verb_negation", "verb", 3),
    ("V_GERUND", "иш", "ish", "verb_gerund", "verb", 4),
    ("V_IMP_ING", "инг", "ing", "verb_imperative", "verb", 5),
    ("V_IMP_SIN", "син", "sin", "verb_imperative", "verb", 5),
    ("AGR_MAN", "ман", "man", "verb_agreement", "verb", 6),
    ("AGR_SAN", "сан", "san", "verb_agreement", "verb", 6),
    ("AGR_MIZ", "миз", "miz", "verb_agreement", "verb", 6),
    ("AGR_SIZ", "сиз", "siz", "verb_agreement", "verb", 6),
    ("AGR_LAR", "лар", "lar", "verb_agreement", "verb", 6),
    ("ADJ_LI", "ли", "li", "adjective", "noun", 1),
    ("ADJ_SIZ", "сиз", "siz", "adjective", "noun", 1),
    ("NOUN_LIK", "лик", "lik", "derivational", "noun|adjective", 1),
    ("NOUN_CHI", "чи", "chi", "derivational", "noun|verb", 1),
    ("ADJ_IY", "ий", "iy", "adjective", "noun", 1),
    ("SIM_DAY", "дай", "day", "similative", "noun", 3),
    ("SIM_DEK", "дек", "dek", "similative", "noun", 3),
    ("INST_LA", "ла", "la", "instrumental", "noun", 3),
    ("V_YOTIR", "йотир", "yotir", "verb_tense", "verb", 4),
    ("V_AYLIK", "айлик", "aylik", "verb_imperative", "verb", 5),
]

# Id, category, priority, enabled, severity.
RULES = [
    ("DAT_ALLOMORPH", "morphological", 1, True, "Grammar"),
    ("LOC_VOICING", "morphological", 2, True, "Grammar"),
    ("ABL_VOICING", "morphological", 2, True, "Grammar"),
    ("DOUBLE_PLURAL", "morphological", 3, True, "Grammar"),
    ("POSS_MUTATION", "morphological", 4, True, "Grammar"),
    ("VERB_AGREEMENT", "agreement", 5, True, "Grammar"),
    ("COPULA_SPACING", "agreement", 6, True, "Grammar"),
    ("SENT_CAPITALIZATION", "punctuation", 7, True, "Punctuation"),
    ("COMMA_SPACE", "punctuation", 8, True, "Punctuation"),
    ("PERIOD_SPACE", "punctuation", 9, True, "Punctuation"),
    ("DOUBLE_SPACE", "punctuation", 10, True, "Style"),
    ("REPEATED_WORD", "style", 11, True, "Style"),
    ("PROPER_NOUN_CAPS", "punctuation", 12, True, "Grammar"),
    ("BRACKET_MATCH", "punctuation", 14, True, "Punctuation"),
    ("NEG_DOUBLE", "agreement", 13, False, "Style"),
]

# Proper nouns, in both scripts.
PROPER_NOUNS = [
    "Тошкент",
    "Самарқанд",
    "Бухоро",
    "Хива",
    "Фарғона",
    "Андижон",
    "Наманган",
    "Навоий",
    "Нукус",
    "Қўқон",
    "Жиззах",
    "Қарши",
    "Термиз",
    "Гулистон",
    "Урганч",
    "Ўзбекистон",
    "Қозоғистон",
    "Тожикистон",
    "Туркманистон",
    "Қирғизистон",
    "Россия",
    "Toshkent",
    "Samarqand",
    "Buxoro",
    "Xiva",
    "Farg'ona",
    "Andijon",
    "Namangan",
    "Navoiy",
    "Nukus",
    "Qo'qon",
    "Jizzax",
    "Qarshi",
    "Termiz",
    "Guliston",
    "Urganch",
    "O'zbekiston",
    "Qozog'iston",
    "Tojikiston",
    "Turkmaniston",
    "Qirg'iziston",
    "Rossiya",
    "Амир Темур",
    "Алишер Навоий",
    "Заҳириддин Муҳаммад Бобур",
    "Абдулла Қодирий",
    "Чўлпон",
    "Ойбек",
    "Ҳамза",
    "Абу Райҳон Беруний",
    "Абу Али ибн Сино",
    "Муҳаммад ал-Хоразмий",
    "Мирзо Улуғбек",
    "Имом Бухорий",
    "Имом Термизий",
    "Аҳмад Яссавий",
    "Ислом Каримов",
    "Шавкат Мирзиёев",
    "Марказий Осиё",
    "Европа",
    "Осиё",
    "Африка",
    "Америка",
    "Сирдарё",
    "Амударё",
    "Зарафшон",
    "Оролбўйи",
    "Орол денгизи",
    "БМТ",
    "АҚШ",
    "МДҲ",
    "ЮНЕСКО",
    "Tashkent",
    "Samarkand",
    "Bukhara",
    "Khiva",
    "Fergana",
    "Amir Temur",
    "Alisher Navoiy",
    "Bobur",
    "Islom Karimov",
    "Shavkat Mirziyoyev",
]

# Latin original, Cyrillic replacement, category. The order is part of the meaning.
EXCEPTIONS = [
    {"original": "Microsoft", "replacement": "Майкрософт", "category": "Brand", "enabled": True},
    {"original": "Google", "replacement": "Гугл", "category": "Brand", "enabled": True},
    {"original": "iPhone", "replacement": "iPhone", "category": "Brand", "enabled": True},
    {"original": "Facebook", "replacement": "Фейсбук", "category": "Brand", "enabled": True},
    {"original": "Linux", "replacement": "Linux", "category": "Brand", "enabled": True},
    {"original": "Samsung", "replacement": "Самсунг", "category": "Brand", "enabled": True},
    {"original": "Apple", "replacement": "Apple", "category": "Brand", "enabled": True},
    {"original": "Windows", "replacement": "Windows", "category": "Brand", "enabled": True},
    {"original": "Android", "replacement": "Android", "category": "Brand", "enabled": True},
    {"original": "Telegram", "replacement": "Телеграм", "category": "Brand", "enabled": True},
    {"original": "YouTube", "replacement": "YouTube", "category": "Brand", "enabled": True},
    {"original": "Instagram", "replacement": "Инстаграм", "category": "Brand", "enabled": True},
    {"original": "WhatsApp", "replacement": "WhatsApp", "category": "Brand", "enabled": True},
    {"original": "Python", "replacement": "Python", "category": "Technical", "enabled": True},
    {"original": "Java", "replacement": "Java", "category": "Technical", "enabled": True},
    {"original": "JavaScript", "replacement": "JavaScript", "category": "Technical", "enabled": True},
    {"original": "SQL", "replacement": "SQL", "category": "Technical", "enabled": True},
    {"original": "API", "replacement": "API", "category": "Technical", "enabled": True},
    {"original": "JSON", "replacement": "JSON", "category": "Technical", "enabled": True},
    {"original": "HTML", "replacement": "HTML", "category": "Technical", "enabled": True},
    {"original": "CSS", "replacement": "CSS", "category": "Technical", "enabled": True},
    {"original": "HTTP", "replacement": "HTTP", "category": "Technical", "enabled": True},
    {"original": "URL", "replacement": "URL", "category": "Technical", "enabled": True},
    {"original": "PDF", "replacement": "PDF", "category": "Technical", "enabled": True},
    {"original": "USB", "replacement": "USB", "category": "Technical", "enabled": True},
    {"original": "WiFi", "replacement": "WiFi", "category": "Technical", "enabled": True},
    {"original": "Toshkent", "replacement": "Тошкент", "category": "Geographic", "enabled": True},
    {"original": "Samarqand", "replacement": "Самарқанд", "category": "Geographic", "enabled": True},
    {"original": "Buxoro", "replacement": "Бухоро", "category": "Geographic", "enabled": True},
    {"original": "Xorazm", "replacement": "Хоразм", "category": "Geographic", "enabled": True},
    {"original": "Farg'ona", "replacement": "Фарғона", "category": "Geographic", "enabled": True},
    {"original": "sentabr", "replacement": "сентябр", "category": "Other", "enabled": True},
    {"original": "oktabr", "replacement": "октябр", "category": "Other", "enabled": True},
    {"original": "MCHJ", "replacement": "МЧЖ", "category": "Other", "enabled": True},
    {"original": "YEVB", "replacement": "ЕВБ", "category": "Other", "enabled": True},
    {"original": "NATO", "replacement": "НАТО", "category": "Other", "enabled": True},
    {"original": "UNESCO", "replacement": "ЮНЕСКО", "category": "Other", "enabled": True},
    {"original": "COVID", "replacement": "КОВИД", "category": "Other", "enabled": True},
    {"original": "COVID-19", "replacement": "КОВИД-19", "category": "Other", "enabled": True},
]

# Prior probabilities of frequent words.
PRIORS = {
    "va": 0.98,
    "ham": 0.95,
    "uchun": 0.94,
    "bilan": 0.92,
    "bu": 0.91,
    "bir": 0.9,
    "emas": 0.88,
    "bor": 0.87,
    "qilish": 0.86,
    "bo'lish": 0.85,
    "yoki": 0.84,
    "lekin": 0.83,
    "so'z": 0.82,
    "matn": 0.8,
    "hujjat": 0.79,
    "imlo": 0.78,
    "lug'at": 0.77,
    "to'g'ri": 0.76,
    "xato": 0.75,
    "tahrirlash": 0.72,
}

"""Small domain vocabularies."""

# Stop words by language.
STOP_ES = "a al ante con de del desde e el ella ellos en entre es esa ese esta este fue ha hasta la las le les lo los me más ni no nos o para pero por que se si sin su sus un una y ya él".split()
STOP_EN = "a an and are as at be been but by did do for from had has have he her him his i if in into is it its me my no not of on or our she so than that the their them then there they this to up us was we were what which who will with you your".split()
# Words that no keyword may be.
STOP_KEYWORDS = "i he she it we they my his her its our their the a an is are was were am be been being to in on at of for and or but not no yes very much more also just only this that these those do does did will would shall should can could may might".split()
# Names that are no vocabulary.
PROPER_NOUNS = "dios jesús jesucristo cristo maría josé god jesus christ mary joseph lord señor espíritu santo spirit holy angel ángel moisés moses israel jerusalem jerusalén pablo paul pedro peter simon simón juan john santiago james judas david abraham yomen cjües".split()
# Endings of Spanish verb forms, and the pattern of English ones.
VERB_SUFFIXES_ES = "aba aban ado amos ando ará arán aron emos endo eron ía ían ido iendo ieron imos irá irán iste ó ás éis".split()
VERB_EN = r"(?i)\b\w+(ed|ing|es|ied|ying)\b"
# New Testament book codes.
NT_BOOKS = "MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV".split()
# Part-of-speech names.
POS = {"sustantivo": "noun", "verbo": "verb", "adjetivo": "adjective", "adverbio": "adverb", "preposición": "preposition", "conjunción": "conjunction", "pronombre": "pronoun", "pron per": "pronoun", "pron pos": "pronoun", "pron ind": "pronoun", "pron dem": "pronoun", "pron int": "pronoun", "s pos": "noun"}
# Rank of each provenance, unknown ones have 0; sources that verified entries displace.
SOURCE_RANK = {"sil_dictionary_verified": 10, "Elicited_Grammar_Aurelio": 9, "SIL_Dictionary_OCR": 8, "SIL_Dictionary_Deep_OCR": 7, "curated_bible_cooccurrence": 7, "SIL_Example_Extraction": 6, "bible_align:MAT01": 5, "grammar_pdf_verified": 5, "grammar_pdf_deep": 4, "bible_alignment_verified": 4, "full_nt_align": 2, "nt_align_v2_p1": 2, "nt_align_v2_p2": 2}
LOW_SOURCES = ["inferred_promotion", "nt_spa_chain_alignment", "en_spa_tol_chain", "nt_phrase_alignment"]
# Confidence of each way to find an entry.
CONFIDENCE = {"dictionary": 0.95, "chain": 0.85, "synonym": 0.80, "bridge": 0.65, "test_pair": 0.92, "default": 0.8}
# Words that show a headword to be a Spanish or English sentence.
INDICATORS = "el la los las de del en es un una que por con para cuando muy trajo puso se yo tu su al lo nos les ustedes muchos oiga llevarán congregaron the is he she it and was his her".split()
HEADWORD_FUNCTION_WORDS = "el la los las un una de del en que es no se su con por para muy".split()
MIXED_LINE_WORDS = "nosotros ustedes ellos porque cuando también entonces".split()
ENTRY_POS = "sustantivo verbo adjetivo adverbio pronombre conjunción preposición interjección".split()
# Letters of one script read as another's, and accents.
CYRILLIC_ONE = ("аеорсухАЕОРСУХтпнкмийКМИЙвВдзлбгфыэьїієґ", "aeopcyxAEOPCYXtpnkmiüKMIÜvVdzlbgfye'iieg")
CYRILLIC_MANY = (("ц", "ts"), ("ж", "zh"), ("щ", "shch"), ("ш", "sh"), ("ю", "yu"), ("я", "ya"), ("ъ", ""))
ACCENTS = ("áéíóúüàèìòùâêîôûäëïöãõçñ", "aeiouuaeiouaeiouaeioaocn")
# Spellings that sound alike, in the order in which they are rewritten.
PHONETIC = (("tsj", "ch"), ("tj", "ch"), ("cj", "ch"), ("pj", "p"), ("ts'", "s"), ("ts", "s"))
SPELLINGS = (("ph", "pj"), ("kh", "cj"), ("th", "tj"), ("sh", "sj"), ("ch", "cj"), ("ü", "u"), ("ö", "o"), ("ï", "i"), ("ë", "e"), ("ʼ", "'"), ("j", "h"), ("h", "j"), ("k", "c"), ("c", "k"))
# Patterns of examples and of rules in grammar texts.
GRAMMAR_EXAMPLES = (
    ("numbered", r"(?m)(?:^|\n)\s*\(?(\d+)\)?\s*([^\n]+)\n\s*['\"]([^'\"]+)['\"]"),
    ("quoted", r"['\"]([^'\"]{5,80})['\"][\s.,:]*['\"]([^'\"]{5,80})['\"]"),
    ("parted", r"([A-Za-záéíóúüñ'']{3,}(?:\s+[A-Za-záéíóúüñ'']+){1,10})\s*[/=]\s*([A-Za-záéíóúüñ'']{3,}(?:\s+[A-Za-záéíóúüñ'']+){1,10})"),
)
GRAMMAR_RULES = (
    ("word_order", r"(?i)(SOV|SVO|VSO|OVS|VOS|OSV)\b.*?order"),
    ("word_order", r"(?i)word\s+order[:\s]+([^\n.]+)"),
    ("word_order", r"(?i)(?:subject|verb|object)\s+(?:precedes|follows|comes?\s+(?:before|after))\s+[^\n.]+"),
    ("word_order", r"(?i)(?:basic|typical|normal|canonical)\s+(?:sentence|clause)\s+(?:order|structure|pattern)[:\s]+([^\n.]+)"),
    ("verb_morphology", r"(?i)verb\s+(?:prefix|suffix|affix|marker|conjugat)[^\n.]*"),
    ("verb_morphology", r"(?i)(?:tense|aspect|mood)\s+(?:marker|suffix|prefix)[^\n.]*"),
    ("verb_morphology", r"(?i)(?:past|present|future)\s+tense[:\s]+[^\n.]+"),
    ("pronouns", r"(?i)(?:personal\s+)?pronoun[s]?\s*[:\-][^\n]+"),
    ("determiners", r"(?i)(?:possessive|demonstrative)\s+[^\n.]+"),
    ("number_marking", r"(?i)(?:plural|number)\s+(?:marker|suffix|prefix)[^\n.]+"),
    ("negation", r"(?i)negat(?:ion|ive)[:\s]+[^\n.]+"),
)
# Constructions that are entered as they are.
GRAMMAR_PATTERNS = (("because of", "mpes", "grammar_pattern", 0.90), ("that is why", "nin mpes", "grammar_pattern", 0.90), ("in order to", "la", "grammar_pattern", 0.85), ("used to", "=cha", "grammar_pattern", 0.85), ("long time", "pülükh", "grammar_pattern", 0.85), ("how many", "nol", "grammar_pattern", 0.90), ("how much", "nol", "grammar_pattern", 0.90))
# Entities of the corpus; the ampersand comes last.
ENTITIES = (("&#160;", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))

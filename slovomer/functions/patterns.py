"""Patterns and constants of the text functions, in the subset on which Java, RE2 and Python agree."""

# Fixed values of the token and sentence contract.
#: A token: number with inner separators, word with inner hyphens, or one sign.
TOKEN_RE = r"[0-9]+(?:[.,][0-9]+)+|[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"
#: A sentence end: stops, white space, then an opening or a capital.
BOUNDARY_RE = r"([.!?…]+[\"»”)]*)\s+([\"«(—]*[\p{Lu}0-9])"

# The alphabet of Russian.
RU_VOWELS = "аеиуояёэюыАЕИУОЯЁЭЮЫ"
RU_CONSONANTS = "бвгджзкпстфхцчшщлмнрйБВГДЖЗКПСТФХЦЧШЩЛМНРЙ"
RU_MARKS = "ьъЬЪ"
RU_LETTERS = RU_CONSONANTS + RU_MARKS + RU_VOWELS
PUNCTUATIONS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~—«»“”..."
SPACES = " \t"
LONG_WORD, COMPLEX_SYLLABLES = 6, 4

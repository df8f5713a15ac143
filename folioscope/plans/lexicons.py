"""Words for the registered queries of text classifiers: frequent syllables of the made-up prose in the test tables, which have no meaning. Real lexicons are the caller's."""

PARADIGMS = {"quantitative": ["antion", "erin", "thwh", "onsh"], "qualitative": ["orre", "eanea", "heit", "thble"], "mixed": ["thatin"]}
DESIGNS = ["tion", "ment", "lich", "ununder", "der und"]
SOFTWARE = ["eaux", "onst", "erre", "ing."]
POSITIVE = ["the", "that", "les", "und", "tion", "was"]
NEGATIVE = ["of", "is", "de", "der", "en"]
HEDGES = ["ou", "or", "an", "er", "re"]
PRACTICES = {"link": r"https?://|www\.", "number": r"\b[0-9]{3,}\b", "mail": r"[a-z]@[a-z]", "license": r"licen[sc]e", "request": r"\brights\b"}

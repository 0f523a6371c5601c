"""Word lists of the rules (fixed values), each tested as a part of the lower-cased text."""

# Project types and methodologies, the first that matches.
TYPE_WORDS = (
    ("embedded", ("embedded", "firmware", "automotive")),
    ("mobile", ("mobile", "ios", "android")),
    ("api", ("api", "microservice", "backend", "rest")),
    ("web", ("web", "browser", "frontend")),
    ("desktop", ("desktop",)),
    ("data", ("data", "ml", "machine learning", "ai")),
)
METHOD_WORDS = (
    ("v-model", ("v-model", "vmodel", "v model")),
    ("waterfall", ("waterfall",)),
    ("agile", ("agile", "scrum", "kanban", "safe")),
)
# Answers.
VAGUE_WORDS = ("tbd", "unknown", "not sure", "don't know", "n/a", "na", "none", "?", "unclear", "maybe", "to be determined")
NO_TEAM_WORDS = ("no dedicated", "none", "developers test")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
NOBODY_WORDS = ("no ", "none", "n/a", "developers test")
NOTHING = ("no", "none", "n/a", "")
NO_TESTS = ("no", "none", "")
# What raises the effort.
NO_AUTOMATION = ("no", "nothing", "none", "not yet", "greenfield")
SOME_AUTOMATION = ("some", "partial", "unit")
EXTERNAL = ("integration", "third-party", "external")
SAFETY = ("asil", "safety")
SAFETY_NORMS = ("iso 26262", "asil")
LEGACY = ("legacy", "cobol", "mainframe")
SPICE = ("a-spice", "aspice", "spice")
LEVEL_3 = ("level 3", "lvl 3", "l3")
ASIL = (
    ("ISO 26262 ASIL D requirement", 40, ("asil d", "asil-d")),
    ("ISO 26262 ASIL C requirement", 30, ("asil c", "asil-c")),
    ("ISO 26262 ASIL B requirement", 20, ("asil b", "asil-b")),
    ("ISO 26262 compliance", 15, ("asil a", "asil-a", "iso 26262", "iso26262")),
)
NORMS = (("GDPR compliance", 10, "gdpr"), ("PCI-DSS compliance", 15, "pci"), ("HIPAA compliance", 15, "hipaa"))

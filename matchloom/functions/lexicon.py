"""Word lists. All are defaults that callers can replace by DataFrames or lists of their own."""

# English stop words (the public list of a common natural language toolkit), which documentation is cleaned by.
STOP_WORDS = tuple(
    """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those
am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by
for with about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
)

# Noun endings and what replaces them, in the order in which they are tried.
NOUN_RULES = (("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", ""))

# Irregular plurals.
NOUN_EXCEPTIONS = {
    "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "people": "people", "oxen": "ox", "indices": "index",
    "matrices": "matrix", "vertices": "vertex", "analyses": "analysis", "diagnoses": "diagnosis", "hypotheses": "hypothesis", "criteria": "criterion",
    "phenomena": "phenomenon", "data": "data", "bacteria": "bacterium", "lives": "life", "wives": "wife", "knives": "knife", "leaves": "leaf",
}

#: A small lexicon of nouns for the default lemmatiser; a real one is read by `sources.lexicon.load_lexicon`.
NOUNS = tuple(
    """
age analysis answer artery attack background basis biopsy birth blood body bone box branch category cause cell center
characteristic child cigarette city class clinic concept condition country criterion date day death description diagnosis
disease document dose drug enzyme event exam factor family father field foot form gamete gender gonad group health heart
history hospital hour individual infarction inheritance interview item kidney label level life list lung man mapping
mass match measure measurement medication method minute model month mother name nation number onset part participant
patient period person phenotype plasma point procedure process pulse question range rate ratio record region result
risk sample scale score sex sister site smoker source stroke study subject surgery symptom system table test
tissue tooth treatment type unit value variable vessel visit wave week weight wife woman word year
""".split()
)

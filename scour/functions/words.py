"""Default word tables of the text operators."""

# English stop words.
STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't
ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't
won won't wouldn wouldn't
""".split()

# English contractions that do not follow a rule below.
IRREGULAR_CONTRACTIONS = {
    "ain't": "are not",
    "can't": "cannot",
    "'cause": "because",
    "'em": "them",
    "'tis": "it is",
    "'twas": "it was",
    "c'mon": "come on",
    "gov't": "government",
    "i'm": "I am",
    "i'd": "I would",
    "i'll": "I will",
    "i've": "I have",
    "let's": "let us",
    "ma'am": "madam",
    "o'clock": "of the clock",
    "shan't": "shall not",
    "won't": "will not",
    "y'all": "you all",
}


def contractions() -> dict[str, str]:
    """Lower-case contraction -> expansion: the regular ones built from their parts, then the irregular ones."""
    out = {}
    for verb in "are could did does do had has have is might must need should was were would".split():
        out[f"{verb}n't"] = f"{verb} not"
    for subject in "you he she it we they who that there what where how".split():
        out[f"{subject}'d"] = f"{subject} would"
        out[f"{subject}'ll"] = f"{subject} will"
        out[f"{subject}'s"] = f"{subject} is"
    for subject in "you we they who could should would might must".split():
        out[f"{subject}'ve"] = f"{subject} have"
    for subject in "you we they who".split():
        out[f"{subject}'re"] = f"{subject} are"
    return out | IRREGULAR_CONTRACTIONS

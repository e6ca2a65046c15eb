"""Documents with what may go wrong: nulls, nothing, much, copies, and columns named as the operators name theirs."""

ODD = "doc_id long, text string, source string, lang string, n_chars long, row string, key string, n string, chunk string, component string, _source string, bucket string"


def documents(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, None if sources is None else sources[i], None, None if t is None else len(t), *["x"] * 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ODD)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


def awkward(rng):
    long = text(rng, 20000)
    return [None, "", " \n\t ", "a", "one two three", long, long, text(rng, 50), "ÀÉ ß 日本 \U0001f600 ▁ \x00 tab\tend", "A B c d E", "a b C D e", None, ""]

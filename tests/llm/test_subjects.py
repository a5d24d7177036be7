import random

import pytest

from quarrymark.llm import latex, subjects

TEXT = r"""\documentclass{article}
\newcommand{\kw}{\textit{query plan}\xspace}
\newcommand\todo[1]{} \def\X{cache hit}
\title{A study of nothing}
\begin{document}\maketitle
\begin{abstract}The \kw{} was slow. % The penalty kick was fast.
A larger \X{} helps 50\% more.\end{abstract}
\keywords{penalty kick}
\section{Penalty kick} First $x % y$ line \todo{penalty kick}\cite{a}.
\iffalse The penalty kick.\fi
\begin{comment}The penalty kick.\end{comment}
\begin{equation} penalty \end{equation}
Gr\"o{\ss}e z\"ahlt~nicht.
\begin{thebibliography}{9}\bibitem{a} Penalty kick.\end{thebibliography}
\end{document} Penalty kick."""


def test_latex():
    lines = [" ".join(latex.words(s)) for s in latex.sentences(TEXT)]
    assert [x for x in lines if x] == ["the query plan was slow", "larger cache hit help more", "first", "größe zählt nicht"]
    assert [" ".join(x) for x in latex.sentence_words(TEXT)] == [x for x in lines if x]


def test_macros_are_expanded_to_the_end():
    chain = "".join(rf"\newcommand{{\m{chr(97 + i)}}}{{\m{chr(98 + i)}}}" for i in range(12)) + r"\def\mm{deep word}"
    assert latex.sentence_words(chain + r"\begin{document}A \ma{} here.\end{document}") == [["deep", "word", "here"]]
    assert latex.sentence_words(r"\def\a{\b more}\def\b{\a less}\begin{document}Some \a{} text.\end{document}") == [["some", "text"]]
    bomb = "".join(rf"\def\x{chr(97 + i)}{{{rf'\x{chr(98 + i)}' * 10}}}" for i in range(20))
    assert isinstance(latex.sentence_words(bomb + r"\begin{document}\xa\end{document}"), list)


def test_a_formula_may_have_any_length():
    assert latex.sentence_words(r"Before $" + "x + y " * 500 + "$ after.") == [["before", "after"]]


@pytest.mark.parametrize("text", [None, "", "%", r"\newcommand{\a}{", r"\begin{document}", r"\def\a{\a}\a", "{{{", "}}}", r"\iffalse x", "plain words only", "\\" * 50])
def test_latex_survives(text):
    assert isinstance(latex.sentences(text), list)


FIELDS = {
    "law": ["appellate court", "burden proof", "liability clause", "tort claim", "jury duty", "statutory term"], "sport": ["penalty kick", "sprint pace", "league ranking", "athlete fatigue", "tackle count", "race season"],
    "software": ["query planner", "cache eviction", "merge conflict", "build pipeline", "memory leak", "static analysis"],
}
FRAMES = ["The {} was recorded in most of the cases", "We examine how the {} depends on the {}", "Earlier accounts of the {} ignored this", "For each {} we kept the median"]


def document(r, shares):
    lines = []
    for field in shares:
        for _ in range(8):
            lines.append(r.choice(FRAMES).replace("{}", r.choice(FIELDS[field])) + ".")
    lines += ["The remainder is organised as follows.", "We thank the readers for their comments."] * 2
    r.shuffle(lines)
    return "\\begin{document}\\begin{abstract}" + " ".join(lines) + "\\end{abstract}\\end{document}"


def test_several_subjects(spark):
    r = random.Random(5)
    truth = {i: r.sample(sorted(FIELDS), r.choice([1, 1, 1, 2])) for i in range(300)}
    rows = [(i, document(r, s)) for i, s in truth.items()] + [(900, None), (901, ""), (902, "This submission has been withdrawn.")]
    labels = [(i, r.choice(s) if r.random() < 0.95 else "law", "x") for i, s in truth.items() if i % 5 == 0] + [(1, None, "x"), (2, "unknown", "x")]
    found = subjects.assigned(
        spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(labels, "doc_id long, subject string, body string"), spark.createDataFrame([(s,) for s in [*FIELDS, "theology", None]], "subject string")
    )
    got = {(x["doc_id"], x["subject"]) for x in found.collect()}
    want = {(i, s) for i, ss in truth.items() for s in ss}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97 and not {i for i, _ in got} & {900, 901, 902}


def test_empty(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.assigned(docs, "doc_id", "text", labels, spark.createDataFrame([("law",)], "subject string")).count() == 0
    assert subjects.assigned(docs.limit(0), "doc_id", "text", labels, labels.select("subject")).count() == 0


def test_every_term_of_the_vocabulary_is_coded(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, document(r, [sorted(FIELDS)[i % 3]])) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, sorted(FIELDS)[i % 3]) for i in range(0, 90, 4)], "doc_id long, subject string")
    coded, terms, *_ = subjects.fitted(docs, "doc_id", "text", labels, labels.select("subject").distinct())
    for x, y in zip(coded.orderBy("key").collect(), subjects.bodies(docs, "doc_id", "text").orderBy("key").collect()):
        words = [y["own"][i] for i in y["places"]]
        assert [terms[i] for i in x["ids"]] == [w for w in words if w in set(terms)] and sum(x["sizes"]) == len(x["ids"]) and sum(y["sizes"]) == len(words)
        assert {terms[i]: n for i, n in zip(x["tf"].indices, x["tf"].values)} == {w: words.count(w) for w in set(words) & set(terms)}

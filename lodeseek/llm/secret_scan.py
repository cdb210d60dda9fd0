"""Secret scans: candidate strings by pattern, and a random forest that removes false positives.

The forest is trained from labelled findings (candidate, before, after, path, label). `labelled_examples`
makes such findings from public formats of credentials and from what is commonly mistaken for them; a user
with reviewed findings passes those. Features are a candidate's length, its character transitions (classes,
and letter pairs against the corpus), how much of it dictionary words cover, its path and the words beside it.

Letter pairs and word counts are taken over all documents. The dictionary is their most frequent words.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import per_batch, text_column, written

#: Words of the dictionary, and labelled findings that a training reads at most.
DICTIONARY_WORDS, MAX_FINDINGS = 20_000, 20_000
#: Tasks that order the words which may be in the dictionary.
SORTERS = 4
TREES, DEPTH, SEED = 40, 8, 17
BESIDE = 48
#: Prefixes of public credential formats, names that credentials are assigned to, words that speak against one.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ", "SG.", "npm_")
NAMES = ("token", "secret", "passw", "pwd", "api_key", "apikey", "auth", "credential", "private", "access_key")
AGAINST = ("sha1", "sha256", "md5", "checksum", "digest", "commit", "uuid", "example", "dummy", "sample", "placeholder", "integrity", "http", "www", "mail", "version")
PLAIN_PATHS = ("test", "example", "doc", "sample", "lock", "fixture")
VALUE = r"[^\s\"'<>,;(){}\[\]"
ASSIGNED = re.compile(r"([A-Za-z][A-Za-z0-9_.-]{0,40})[\"']?[ \t]*(?:=|:=|:|=>)[ \t]*[\"']?(" + VALUE + "]{8})")
BARE = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=.-]{16,}")
#: Capital letters inside a string without digits.
MIXED = re.compile("(?<=[a-z])[A-Z]")
#: A value up to what ends it in a URL or connection string; and up to a further assignment, for values inside more than NESTED others.
WHOLE, PART, INNER, NESTED = re.compile(VALUE + "]+"), re.compile("[^&@#|]+"), re.compile(VALUE + "&@#|:=?]+"), 8
#: The next field of a URL's query, which is in no value.
QUERY = re.compile("&[A-Za-z_][A-Za-z0-9_.-]*=")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CLASS = np.full(128, 3, np.int8)
for _chars, _k in ((LETTERS, 0), (LETTERS.upper(), 1), ("0123456789", 2)):
    _CLASS[[ord(c) for c in _chars]] = _k


@dataclass
class Corpus:
    """Log shares of letter pairs (26 x 26) and the dictionary of a corpus."""

    pairs: np.ndarray
    dictionary: frozenset[str]


def corpus_statistics(docs: DataFrame, words: int = DICTIONARY_WORDS) -> Corpus:
    """Letter pairs and the most frequent words (3 to 12 letters, ties in alphabetical order) of all texts."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for text in batch.column("text").to_pylist():
            seen.update(re.findall(r"[a-z]+", (text or "").lower()))
        pairs: Counter = Counter()
        for w, n in seen.items():
            for a, b in zip(w, w[1:]):
                pairs["\0" + a + b] += n
        own = [(w, n) for w, n in seen.items() if 3 <= len(w) <= 12] + list(pairs.items())
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

    counts = per_batch(text_column(docs.select("text")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    is_pair = F.col("word").startswith("\0")
    table = np.ones((26, 26))
    for r in counts.where(is_pair).collect():  # 676 at most
        table[ord(r.word[1]) - 97, ord(r.word[2]) - 97] += r.n
    return Corpus(np.log(table / table.sum(1, keepdims=True)), frozenset(_most_frequent(counts.where(~is_pair), words)))


def _most_frequent(counts: DataFrame, k: int) -> list[str]:
    """The k words of counts(word, n) with the highest n.

    How many words have about which n says from where on the k highest are, so that only words from there on are ordered, in
    SORTERS tasks that send k words each at most.
    """
    about = F.floor(F.log2("n") * 64)  # 64 steps for each doubling: 4,096 rows at most
    least, left = 0, k
    for r in counts.groupBy(about.alias("about")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("about")).collect():
        least, left = r.n, left - r.words
        if left <= 0:
            break
    top = counts.where(F.col("n") >= least).coalesce(SORTERS).orderBy(F.desc("n"), "word").limit(k)
    return [r.word for r in top.collect()]


def covered(text: str, dictionary: frozenset[str]) -> tuple[float, int]:
    """(share of characters that dictionary words cover when as many as can be are, longest word among them)."""
    n = len(text)
    if not n:
        return 0.0, 0
    best, longest = [0] * (n + 1), 0
    for i in range(1, n + 1):
        best[i] = best[i - 1]
        for k in range(3, min(12, i) + 1):
            if text[i - k : i] in dictionary:
                longest = max(longest, k)
                best[i] = max(best[i], best[i - k] + k)
    return best[n] / n, longest


FEATURES = ["length", "digits", "upper", "lower", "other", "distinct", "entropy", "class_changes", "letter_pairs", "covered", "longest_word", "hex", "prefix", "name", "assigned", "against", "near_name", "plain_path", "mail_or_path"]
PREFIX, NAME = FEATURES.index("prefix"), FEATURES.index("name")


def features(candidate: str, name: str, before: str, after: str, path: str, corpus: Corpus) -> list[float]:
    n = len(candidate)
    raw = np.frombuffer(candidate.encode("ascii", "replace"), np.uint8)
    kind = _CLASS[np.minimum(raw, 127)]
    shares = np.bincount(kind, minlength=4) / n
    counts = np.array(list(Counter(candidate).values())) / n
    low = candidate.lower()
    pair = [(ord(a) - 97, ord(b) - 97) for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
    flow = float(corpus.pairs[tuple(np.array(pair).T)].mean()) if pair else -6.0
    share, longest = covered(low, corpus.dictionary)
    around, label = f"{before} {after}".lower(), name.lower()
    return [
        math.log(n), float(shares[2]), float(shares[1]), float(shares[0]), float(shares[3]), len(counts) / n, float(-(counts * np.log2(counts)).sum()),
        float((kind[1:] != kind[:-1]).sum()) / n, flow, share, longest / n, float(re.fullmatch(r"[0-9a-fA-F]+", candidate) is not None),
        float(candidate.startswith(PREFIXES)), float(any(x in label for x in NAMES)), float(bool(name)), float(any(x in around or x in low or x in label for x in AGAINST)),
        float(any(x in before.lower() for x in NAMES)), float(any(x in path.lower() for x in PLAIN_PATHS)), float(before.endswith(("@", "/", "://", ".")) or after.startswith(("@", "/"))),
    ]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name it is assigned to or nothing) of strings that could be secrets: values of an assignment, and long mixed strings.

    Texts of any length are read in time that grows with them: a run of assignments is read to its end NESTED times at most. They may lie inside each other: the value of an assignment may hold further assignments, end at a mark of a URL, or
    hold long strings.
    """
    out = {}
    for m in BARE.finditer(text):
        s = m[0].rstrip(".=-/_+") or m[0]
        if len(s) >= 16 and re.search("[A-Za-z]", s) and (re.search("[0-9]", s) or len(s) >= 20 and len(MIXED.findall(s)) >= 3):
            out[m.start(), m.start() + len(s)] = ""
    bare, level, outer = sorted(out), 0, -1
    at = 0
    while m := ASSIGNED.search(text, at):
        at = m.start(2)  # the next assignment may be inside this value
        level = level + 1 if m.start() < outer else 0
        values = []
        if level < NESTED:  # a run is read to its end so many times at most
            whole = WHOLE.match(text, at)[0]
            outer = outer if level else at + len(whole)
            values.append(QUERY.split(whole, maxsplit=1)[0].rstrip("."))
        x = PART.match(whole) if level < NESTED else INNER.match(text, at)
        if x and x[0] not in values:
            values.append(x[0])
        for s in values:
            if len(s) < 8 or not re.search("[0-9A-Za-z]", s):
                continue
            for k in bare[max(0, bisect_left(bare, (at, 0)) - 1) : bisect_left(bare, (at, 0))]:
                if k[0] < at < k[1]:  # it runs over the name
                    out.pop(k, None)
            out[at, at + len(s)] = m[1]
    return sorted((a, b, name) for (a, b), name in out.items())


def _best(opens: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of candidates that overlap none of a higher score; ties go to the first and then to the longest."""
    bounds = np.append(np.flatnonzero(opens), len(opens))
    keep = np.ones(len(opens), bool)
    for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
        held: list[tuple[int, int]] = []  # in order, none over another
        for k in sorted(range(bounds[i], bounds[i + 1]), key=lambda k: (-score[k], start[k], -end[k])):
            a, b = int(start[k]), int(end[k])
            at = bisect_left(held, (a, a))
            keep[k] = (at == 0 or held[at - 1][1] <= a) and (at == len(held) or b <= held[at][0])
            if keep[k]:
                held.insert(at, (a, b))
    return np.flatnonzero(keep)


def labelled_examples(corpus: Corpus, n: int = 6000, seed: int = SEED) -> list[tuple[str, str, str, str, str, int]]:
    """(candidate, name, before, after, path, label): n findings, half of them secrets, made from a fixed seed."""
    r = random.Random(seed)
    words = sorted(corpus.dictionary) or ["lorem", "ipsum", "dolor", "amet"]
    alnum, hexa = LETTERS + LETTERS.upper() + "0123456789", "0123456789abcdef"
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    say = lambda k: " ".join(r.choices(words, k=k))
    secret_names = ["token", "password", "passwd", "secret", "api_key", "auth_token", "access_key", "client_secret", "db_password", "private_key"]
    other_names = ["name", "id", "version", "checksum", "sha256", "commit", "image", "path", "color", "class", "title", "hash"]

    def secret():
        name = r.choice(secret_names) if r.random() < 0.7 else ""
        value = r.choice([
            lambda: "AKIA" + pick(LETTERS.upper() + "0123456789", 16), lambda: pick(hexa, r.choice([16, 18, 20, 32, 40, 64])), lambda: pick(alnum, r.randrange(16, 48)),
            lambda: r.choice(["ghp_", "glpat-", "sk_live_", "npm_"]) + pick(alnum, r.randrange(20, 40)), lambda: "eyJ" + pick(alnum + "_-", 60) + "." + pick(alnum + "_-", 40), lambda: pick(alnum + "+/", 40) + "=",
        ])()
        if not name and re.fullmatch("[0-9a-f]+", value):
            name = r.choice(secret_names)
        return value, name, f"{say(3)} {name}{r.choice(['=', ' = ', ': ']) if name else ' '}", f" {say(3)}", r.choice(["src/app.py", "config/prod.env", "", "src0", "deploy.yml"])

    def other():
        kind = r.randrange(8)
        name, before, after = "", say(3) + " ", " " + say(3)
        if kind == 0:
            value, name = pick(hexa, r.choice([32, 40, 64])), r.choice(["sha256", "checksum", "commit", "md5", "digest"])
        elif kind == 1:
            value = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
            name = r.choice(["", "uuid", "id"])
        elif kind == 2:
            value, name = r.choice(["your_api_key_here", "changeme_please", "example-token-1234", "dummy_secret_value1", "xxxxxxxxxxxxxxxx", "placeholder123456"]), r.choice(secret_names)
        elif kind == 3:
            value = f"{r.choice(['mail', 'www', 'host', 'cdn'])}{r.randrange(10)}.{r.choice(words)}.{r.choice(['com', 'org', 'net'])}"
            before += pick(LETTERS, 6) + r.choice(["@", ".42@", "://", "/"])
        elif kind == 4:
            value = "/".join(r.choices(words, k=4)) + str(r.randrange(100))
        elif kind == 5:
            value, name = "".join(r.choices(words, k=r.randrange(3, 6))) + r.choice(["", str(r.randrange(10))]), r.choice([*other_names, *secret_names[:3], ""])
        elif kind == 6:
            value, name = "_".join(r.choices(words, k=4)) + r.choice(["", "2", "V1"]), r.choice(["", *other_names])
        else:
            value, name = r.choice(words) + "," + r.choice(words) + r.choice(words), r.choice(words)
        if name:
            before += name + r.choice(["=", ": "])
        return value, name, before, after, r.choice(["tests/test_app.py", "docs/guide.md", "package-lock.json", "", "src0", "src/app.py"])

    return [(*secret(), 1) if i % 2 else (*other(), 0) for i in range(n)]


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, str, int]], corpus: Corpus) -> RandomForestClassificationModel:
    """A forest from labelled findings, MAX_FINDINGS at most."""
    if len(findings) > MAX_FINDINGS:
        findings = random.Random(SEED).sample(findings, MAX_FINDINGS)
    rows = [(features(c, name, before[-BESIDE:], after[:BESIDE], path, corpus), float(y)) for c, name, before, after, path, y in findings]
    data = spark.createDataFrame(rows, "x array<double>, label double").coalesce(1)  # bounded; one order of rows gives one forest
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="v", labelCol="label")
    return forest.fit(data.select(array_to_vector("x").alias("v"), "label"))


def findings(docs: DataFrame, model: RandomForestClassificationModel, corpus: Corpus, path: str = "source") -> DataFrame:
    """(doc_id, start, end, name, secret, score) for candidates of docs(doc_id, text[, path]); start and end count characters.

    Of candidates that overlap, those with the highest scores stay; one with score 0.5 and
    a credential's prefix or name goes before all without, which may be a URL or log line around it.
    Null and empty texts have no candidates. Repeated rows give their findings each. Extra columns are not
    read; without a path column paths are empty.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(corpus)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        which, rows = [], []
        for i, (text, at) in enumerate(zip(batch.column("text").to_pylist(), batch.column("path").to_pylist())):
            text = text or ""
            reach = -1
            for a, b, name in candidates(text):
                x = features(text[a:b], name, text[max(0, a - BESIDE) : a], text[b : b + BESIDE], at, shared.value)
                which.append(i)
                rows.append((a, b, name, text[a:b], x, a >= reach, x[PREFIX] + x[NAME] > 0))
                reach = max(reach, b)
        a, b, name, secret, x, opens, known = zip(*rows) if rows else ((),) * 7
        cols = [batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(name, pa.string()), pa.array(secret, pa.string()), pa.array(x, pa.list_(pa.float64())), pa.array(opens, pa.bool_()), pa.array(known, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "end", "name", "secret", "x", "opens", "known"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a document are next to each other, as no shuffle is between; a group may go on in the next batch
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.concat_batches([held, batch]) if held is not None else batch
            last = int(np.flatnonzero(batch.column("opens").to_numpy(zero_copy_only=False))[-1])
            held = batch.slice(last)
            yield pick(batch.slice(0, last))
        if held is not None:
            yield pick(held)

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        opens, start, end, score, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "start", "end", "score", "known"))
        found = _best(opens, start, end, score + (known & (score >= 0.5)))
        return batch.take(pa.array(found)).select(["doc_id", "start", "end", "name", "secret", "score"])

    rows = per_batch(text_column(docs.select("doc_id", "text", where.alias("path"))), run, f"doc_id {kind}, start long, end long, name string, secret string, x array<double>, opens boolean, known boolean")
    scored = model.transform(rows.withColumn("v", array_to_vector("x")))
    scored = scored.select("doc_id", "start", "end", "name", "secret", vector_to_array("probability")[1].alias("score"), "opens", "known")
    return scored.mapInArrow(best, f"doc_id {kind}, start long, end long, name string, secret string, score double")


def scan(docs: DataFrame, labelled: list[tuple[str, str, str, str, str, int]] | None = None, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """The findings that the forest takes for secrets, from all of docs."""
    corpus = corpus_statistics(docs)
    model = train(docs.sparkSession, labelled or labelled_examples(corpus), corpus)
    return findings(docs, model, corpus, path).where(F.col("score") >= threshold)

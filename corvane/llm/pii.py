"""Personal information in free text, found by bootstrapped contextual extraction.

Candidates of each kind are found by form alone: number groups, street-like
phrases, words that could be names, addresses of mail.  Seeds are candidates
whose form or listing leaves no doubt.  The contexts in which candidates stand
(the words before them) and the instances (shapes of numbers and addresses of
mail, words of streets and names) make a graph whose edges are counted over all
texts; scores flow from seeds to contexts, from contexts to instances, and back.
Contexts and instances of high score then find the identifiers that no seed
covers, and contexts of low score keep order, model and serial numbers out.

Texts are read once, for candidates; graph, scores and decisions are tables that
are joined, so nothing has to fit the driver.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.canonical import IGNORABLE_RANGES, canonical
from corvane.operators.durable import broadcast_below, cut

KINDS = ("email", "phone", "id_number", "address", "person")

# Words that name a kind of street or a part of a building, as written before or after the proper name.
STREET_AFTER = "street road lane avenue drive court way blvd boulevard mews place square close crescent terrace hill row str st rd ave ln dr ct"
STREET_BEFORE = "c/ calle avenida plaza paseo camino rua travessa via viale piazza corso rue allée avenue boulevard chemin impasse quai place"
STREET_ENDINGS = "straße strasse str. str weg gasse platz allee"
DWELLINGS = "flat apt apartment unit suite wohnung piso apto appartement"
LINKS = "de la|de las|de los|de l'|del|des|de|du|do|da|dos|das|della|dello|degli|di|d'"

_alt = "|".join
_WORD = r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*"
_NUMBER = r"\d{1,4}[a-z]?"
_DWELLING = rf"(?:(?:{_alt(DWELLINGS.split())})\.? \d{{1,4}}[a-z]?,? )?"
_BEFORE = rf"(?:{_alt(STREET_BEFORE.split())}) (?:(?:{LINKS}) ?)?{_WORD}(?: {_WORD}){{0,2}}?"
ADDRESS = re.compile(
    r"(?<![\w@.+/-])(?:"
    rf"{_DWELLING}{_NUMBER},? (?:{_BEFORE}|(?:{_WORD} ){{1,3}}?(?:{_alt(STREET_AFTER.split())})(?!\w)|{_WORD}(?:{_alt(map(re.escape, STREET_ENDINGS.split()))})(?!\w))"
    rf"|{_BEFORE},? {_NUMBER}(?!\w)"
    rf"|(?:{_WORD} )?{_WORD} ?(?:{_alt(map(re.escape, STREET_ENDINGS.split()))}) {_NUMBER}(?!\w)"
    rf"|(?:{_WORD} )?{_WORD} (?:{_alt(STREET_AFTER.split())})\.? {_NUMBER}(?!\w)"
    r")",
    re.I,
)
_ADDRESS_TAIL = re.compile(rf"\.?(?: (?:{_alt(DWELLINGS.split())})\.? ?\d|,? \d{{1,2}}º|, \d{{5}}|, [A-Z]|,? \d{{5}} [A-Z])", re.I)
_DOT = r"(?:\.| ?[\[(]dot[\])] ?| (?:dot|DOT) )"
_SAID_DOT = r"(?: ?[\[(]dot[\])] ?| (?:dot|DOT) )"
_LOCAL = r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*"
EMAIL = re.compile(
    rf"{_LOCAL}(?:(?:{_SAID_DOT}[\w+-]+)*(?: ?[\[(]at[\])] ?)[\w-]+(?:{_DOT}[\w-]+)+"
    rf"| ?@ ?[\w-]+(?:{_DOT}[\w-]+)+"
    rf"|(?:{_SAID_DOT}[\w+-]+)* (?:at|AT) [\w-]+(?:\.[\w-]+)*{_SAID_DOT}[\w-]+(?:{_DOT}[\w-]+)*(?![\w-])(?! ?(?:@|[\[(]at|at |AT )))",
)
NUMBER = re.compile(
    r"(?<![\w@#.+/-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\) ?)?\d[\d .-]*\d"
    r"|\(\d{2,5}\)[ .-]?\d[\d .-]*\d"
    r"|[A-Z]{2} \d\d \d\d \d\d [A-Z](?!\w)"
    r"|[A-Z]{0,2}\d[\dA-Z]*(?:[ ./-][\dA-Z]*\d[\dA-Z]*|-[A-Z](?!\w))*)(?: ?(?:ext|Durchwahl)\.? ?\d{1,5})?(?!\w)"
)
PHONE_SEED = re.compile(r"\+9.*|.* ext\. 9+|\(999\) 999-9999|00 99 .*")
ID_SEED = re.compile(r"999-99-9999|AA 99 99 99 A|9999 9999 9999|99999999-A")
_INITIAL = re.compile(r"[^\W\d_]\.")
_EDGE = "()[]{}<>\"'“”„«»‹›,;:!?…/*_~"


class _Fold(dict):
    """Code point to text; a letter of another script that looks Latin becomes Latin only beside Latin ones (see fold)."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = form = " " if ch.isspace() else canonical(ch)
        return form


_FOLD = _Fold()
# Characters that vanish or join the one before: in texts without them, folding to the same length keeps every place.
_UNEVEN = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in [*IGNORABLE_RANGES, (0x0300, 0x034E), (0x0483, 0x0487), (0x0591, 0x05BD), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)]) + "]")


_BREAKS = re.compile(r"[\n\r\t]")


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text in one form, and for each of its characters the position in the original (None: the same position)."""
    if text.isascii():
        return (" ".join(_BREAKS.split(text)) if _BREAKS.search(text) else text, None)
    folded = text.translate(_FOLD)
    if len(folded) == len(text) and not _UNEVEN.search(text):
        return folded, None
    out, at, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        form = _FOLD[ord(text[i])] if j == i + 1 else canonical(text[i:j])
        out.append(form)
        at.extend([i] * len(form))
        i = j
    return "".join(out), at


def shape(number: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", number))


class _Norms(dict):
    """Token to the form in which it stands in a context; emptied when it holds half a million."""

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        word = token[-1] if token.endswith(("(", "[")) else re.sub(r"\d", "9", token).lower().strip(".,;!?\"'") or token[-1:]
        self[token] = word
        return word


class _Classes(dict):
    """Token to one character: N name part, i initial, S street word, C capitalised, a digit the number of digits, else -."""

    def __init__(self, names: set[str]):
        super().__init__()
        self.names = names

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[token] = found = self._class(token)
        return found

    def _class(self, token: str) -> str:
        if digits := _DIGIT.findall(token):
            return str(min(len(digits), 9))
        word = token if token.isalpha() else token.strip(_EDGE)
        bare = word if word.isalpha() else word.rstrip(".").removesuffix("'s").removesuffix("’s")
        if len(word) == 2 and _INITIAL.fullmatch(word) and word[0].isupper():
            return "i"
        if bare.casefold() in self.names:
            return "N"
        low = bare.lower()
        if low in _STREETS or token.lower().lstrip(_EDGE) in _STREETS or low.endswith(_ENDINGS):
            return "S"
        return "C" if bare[:1].isupper() and bare[1:].islower() and bare.isalpha() else "-"


_DIGIT = re.compile(r"\d")
_TOKENS = re.compile(r"\S+")
_PLAIN_MAIL = re.compile(r"[\w+.-]+@[\w.-]+\.\w{2,}")
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+"
_BROAD = re.compile(rf"(?<![\w.+/#-])(?:{_NUMBER},? (?P<after>{_CAP}(?: {_CAP}){{0,2}})|(?P<before>{_CAP}(?: {_CAP}){{0,2}}) {_NUMBER}(?![\w./%-]))")
_BROAD_CLASSES = re.compile(r"[1-4][NC]|[NC][1-4]")
_ENDINGS = tuple(STREET_ENDINGS.split())
_STREETS = set((STREET_AFTER + " " + STREET_BEFORE).split())
_ENDS = (".", ",", ";", ":", "!", "?", ")", "…", "]")
_LONG_NUMBER = re.compile(r"[6-9]|[1-9]{2}|[iSNC-][1-9][1-9iSNC-][1-9]")


class Finder:
    """Finds candidates in one text; holds the listed name parts and memos of tokens."""

    def __init__(self, names: set[str]):
        self.classes, self.norms = _Classes(names), _Norms()

    def context(self, tokens: list[str], k: int, inside: bool) -> str:
        """The last two words before token k; with inside, token k itself opens with a bracket that counts as a word."""
        left = [self.norms[t] for t in tokens[max(0, k - 2) : k]]
        if inside:
            left = [*left[-1:], tokens[k][0]]
        return " ".join(left)

    @staticmethod
    def ends_sentence(token: str) -> bool:
        """Whether a capital after this token means nothing; a short capitalised word with a full stop is a title or an initial."""
        return token[-1] in ".!?…" and not (len(token) <= 4 and token[0].isupper())

    def people(self, tokens: list[str], classes: str) -> Iterator[tuple[int, int, bool]]:
        """(first token, after the last, whether a sentence begins there) of runs of name parts, initials, capitalised words, and small words beside name parts (l)."""
        k, n = 0, len(tokens)
        while k < n:
            if classes[k] not in "NiCl":
                k += 1
                continue
            first = k
            while k < n and classes[k] in "NiCl":
                k += 1
                if classes[k - 1] != "i" and tokens[k - 1].endswith(_ENDS):
                    break
            if any(c in "NC" for c in classes[first:k]):
                yield first, k, not first or self.ends_sentence(tokens[first - 1])

    def candidates(self, folded: str) -> Iterator[tuple]:
        """(kind, start, end, instance, the two words before, flags, run) of every candidate.

        Before a word of a person it is one word, marked ~, where that begins the
        sentence.

        Those of mail, listed streets and numbers don't overlap.  A street is also
        whatever stands capitalised beside a number: `broad`.  Of persons every word
        of a run is a row; flags say that a sentence begins before it (1), that the
        run can't go on after it (2), that it is small (8), that it follows a listed name part
        (16) or an initial (32) of its run, and what it is: a listed name part (64), an
        initial (128), a small word beside a name part (256), or none of these.
        """
        tokens = folded.split()
        classes = "".join(map(self.classes.__getitem__, tokens))
        mail = "@" in folded or "(at" in folded or "[at" in folded or " dot " in folded or "dot]" in folded or "dot)" in folded or " DOT " in folded
        street, number, person, broad = "S" in classes, _LONG_NUMBER.search(classes), "N" in classes or "C" in classes, _BROAD_CLASSES.search(classes)
        if not (mail or street or number or person):
            return
        ends = list(accumulate(map(len, tokens)))
        even = ends[-1] + len(tokens) - 1 == len(folded)  # one blank between tokens, none around them
        places = [e - len(t) + k for k, (e, t) in enumerate(zip(ends, tokens))] if even else [m.start() for m in _TOKENS.finditer(folded)]
        taken: list[tuple[int, int]] = []

        def around(start: int) -> str:
            k = bisect_right(places, start) - 1
            return self.context(tokens, k, places[k] < start)

        if mail:
            for m in EMAIL.finditer(folded):
                taken.append(m.span())
                form = "plain" if _PLAIN_MAIL.fullmatch(m.group()) else "brackets" if "[" in m.group() or "(" in m.group() else "spaced" if "@" in m.group() else "said"
                yield "email", m.start(), m.end(), form, around(m.start()), 0, 0
        if street:
            at = 0
            while m := ADDRESS.search(folded, at):
                at = m.end()
                if any(a < m.end() and m.start() < z for a, z in taken):
                    continue
                start = self._street_start(folded, m)
                tail = "tailed" if _ADDRESS_TAIL.match(folded, m.end()) else "bare"
                taken.append((start, m.end()))
                yield "address", start, m.end(), f"{tail} {'number first' if folded[start].isdigit() else 'name first'}", around(start), 0, 0
        if number:
            for m in NUMBER.finditer(folded):
                if sum(c.isdigit() for c in m.group()) >= 6 and not any(a < m.end() and m.start() < z for a, z in taken):
                    taken.append(m.span())
                    yield "number", m.start(), m.end(), shape(m.group())[:40], around(m.start()), 0, 0
        if broad:
            for m in _BROAD.finditer(folded):
                if not any(a < m.end() and m.start() < z for a, z in taken):
                    word = (m["after"] or m["before"]).split()
                    yield "broad", m.start(), m.end(), word[-1].casefold(), around(m.start()), 0, 0
        if person:
            if "N" in classes:
                classes = "".join("l" if c == "-" and "N" in classes[max(0, k - 1) : k + 2] and tokens[k].strip(_EDGE).rstrip(".").isalpha() else c for k, c in enumerate(classes))
            for run, (first, after, begins) in enumerate(self.people(tokens, classes)):
                if after - first == 1 and begins and classes[first] == "C":
                    continue  # a capital at the begin of a sentence says nothing
                for k in range(first, after):
                    token = tokens[k]
                    if token.isalpha():
                        bare, start, end = token.casefold(), places[k], places[k] + len(token)
                    else:
                        bare = token.strip(_EDGE).rstrip(".").removesuffix("'s").removesuffix("’s").casefold()
                        start, end = places[k] + len(token) - len(token.lstrip(_EDGE)), places[k] + len(token.rstrip(_EDGE + "."))
                    if classes[k] == "i":
                        end = max(end, start + 1)
                    if taken and any(a < end and start < z for a, z in taken):
                        continue
                    alone = k <= 1 or self.ends_sentence(tokens[k - 2])
                    flags = (1 if begins and k == first else 0) | (2 if k + 1 == after else 0) | (8 if folded[start : start + 1].islower() else 0) | ({"N": 16, "i": 32}.get(classes[k - 1], 0) if k > first else 0)
                    before = "~" + self.norms[tokens[k - 1]] if alone and k else self.context(tokens, k, False)
                    yield "person", start, end, bare, before, flags | _CLASS_FLAGS.get(classes[k], 0), run

    @staticmethod
    def _street_start(folded: str, m: re.Match) -> int:
        """Where the street or number begins: words before a lower-case street name that aren't part of it are left out."""
        text = m.group()
        if text[:1].isdigit() or text.split()[0].lower().rstrip(".") in DWELLINGS.split() + STREET_BEFORE.split():
            return m.start()
        words = text.split()
        for k in range(len(words) - 2, 0, -1):
            if words[k - 1].lower() in _LEADS or words[k - 1][:1].islower() and words[k][:1].isupper():
                return m.start() + len(" ".join(words[:k])) + 1
        return m.start()


# Function words that stand before an address and never begin a street name.
_LEADS = set("to at in an a en the der die das dem den up: auf zu nach von em na no al bei it".split())


_CLASS_FLAGS = {"N": 64, "i": 128, "l": 256}
_CANDIDATE = "kind string, start_pos int, end_pos int, instance string, two string, flags int, run int"


def _flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(bit) != 0


def _one() -> Column:
    """The last word before as a context of its own."""
    return F.concat(F.lit("~"), F.substring_index("two", " ", -1))


def _candidates(rows: DataFrame, id_col: str, text_col: str, names: set[str]) -> DataFrame:
    """(id, text_no, kind, start_pos, end_pos, instance, two, flags, run): all candidates, positions in the original text.

    text_no numbers the input's rows, so that repeated ids don't mix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for b in batches:
            owner, found = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                folded, at = fold(text)
                for c in finder.candidates(folded):
                    owner.append(i)
                    found.append(c if at is None else (c[0], at[c[1]], at[c[2] - 1] + 1, *c[3:]))
            columns = list(zip(*found)) or [()] * 7
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            taken = pa.array(owner, pa.int32())
            names_ = ["id", "text_no", "kind", "start_pos", "end_pos", "instance", "two", "flags", "run"]
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), *(pa.array(c, k) for c, k in zip(columns, kinds))], names_)

    kind = rows.schema[id_col].dataType.simpleString()
    needed = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("text_no"), F.col(text_col).alias("text"))
    return cut(needed.mapInArrow(run, f"id {kind}, text_no long, {_CANDIDATE}"), by="kind")


@dataclass(frozen=True)
class PiiScores:
    """contexts (target, context, s) and instances (target, instance, s) with their scores.

    Only contexts that say something are kept: those with s of 0.3 or more, and
    those of numbers and streets that could at most have 0.1, which keep others
    out; only instances with s of 0.3 or more.
    """

    contexts: DataFrame
    instances: DataFrame


def _graph(found: DataFrame) -> DataFrame:
    """(target, context, instance, seed, n): the edges of all kinds, counted over all texts.

    Listed streets are seeds of the contexts that broad candidates stand in; to
    follow a listed name part or an initial is a context too.
    """
    instance, name = F.col("instance"), _flag(64)
    seeds = {
        "email": (["email"], instance.isin("plain", "brackets")),
        "phone": (["number"], instance.rlike(f"^(?:{PHONE_SEED.pattern})$")),
        "id_number": (["number"], instance.rlike(f"^(?:{ID_SEED.pattern})$")),
        "address": (["address"], instance.startswith("tailed")),
        "broad": (["address", "broad"], F.col("kind") == "address"),
        "person": (["person"], name),
    }
    of = F.explode(F.filter(F.array(*[F.when(F.col("kind").isin(kinds), F.struct(F.lit(t).alias("target"), seed.alias("seed"))) for t, (kinds, seed) in seeds.items()]), lambda x: x.isNotNull()))
    left = F.when(_flag(16), "<N").when(_flag(32), "<i")
    contexts = F.filter(F.array(F.when(~_flag(1), F.col("two")), F.when(F.col("kind") != "person", _one()), left), lambda x: x.isNotNull())
    told = (F.col("kind") != "person") | ~(_flag(128) | _flag(256))
    edges = found.where(told).select(of.alias("t"), contexts.alias("contexts"), "instance").select("t.target", F.explode("contexts").alias("context"), "instance", "t.seed")
    return cut(edges.groupBy("target", "context", "instance", "seed").agg(F.count("*").alias("n")))


def score(found: DataFrame, *, rounds: int = 4, least: float = 0.05) -> PiiScores:
    """Scores of contexts and instances, from seeds outwards, in rounds over the graph of all candidates.

    A context's score is the share of its candidates, weighted by their
    instances' scores; an instance's is that share over its contexts, seeds keep
    1.  Both are damped by one unseen case that speaks against them; what a
    context could at most be counts that case for it, so that few cases never
    settle that a context keeps others out.  Scores under `least` aren't passed
    on, so each round meets the graph with few scores, not with all its nodes.
    """
    graph = _graph(found)
    of_context = cut(graph.groupBy("target", "context").agg(F.sum("n").alias("of")))
    of_instance = cut(graph.groupBy("target", "instance").agg(F.sum("n").alias("of"), F.max("seed").alias("seed")))
    seeds = of_instance.where("seed").select("target", "instance", F.lit(1.0).alias("s"))
    instances, contexts = seeds, None

    def passed(scored: DataFrame, scored_by: str, to: str, totals: DataFrame) -> DataFrame:
        """(target, to, s): what reaches the other side of the graph from scores large enough to be passed on."""
        met = graph.join(broadcast_below(scored.where(F.col("s") >= least), 200_000), ["target", scored_by])
        mass = cut(met.groupBy("target", to).agg(F.sum(F.col("n") * F.col("s")).alias("mass")))
        return cut(totals.join(broadcast_below(mass, 200_000), ["target", to]).select("target", to, (F.col("mass") / (F.col("of") + 1)).alias("s")))

    for _ in range(rounds):
        contexts = passed(instances, "instance", "context", of_context)
        found_ = passed(contexts, "context", "instance", of_instance).join(broadcast_below(seeds.select("target", "instance"), 200_000), ["target", "instance"], "left_anti")
        instances = cut(found_.unionByName(seeds))
    strong = contexts.where("s >= 0.3")
    settled = of_context.where(F.col("target").isin("phone", "id_number", "address") & (F.col("of") >= 9)).join(contexts, ["target", "context"], "left")
    least_s = F.coalesce("s", F.lit(0.0))
    weak = settled.where(least_s + 1 / (F.col("of") + 1) < 0.1).select("target", "context", least_s.alias("s"))
    return PiiScores(cut(strong.unionByName(weak)), cut(instances.where("s >= 0.3")))


def _scored(found: DataFrame, scores: PiiScores, target: str) -> DataFrame:
    """found with s_two and s_one, the scores of its contexts, and f, that of its instance; null where they say nothing."""
    known = scores.contexts.where(F.col("target") == target)
    if target == "person":
        found = found.withColumn("s_one", F.lit(None).cast("double"))
    else:
        ones = known.select(F.col("context").alias("one"), F.col("s").alias("s_one"))
        found = found.withColumn("one", _one()).join(broadcast_below(ones, 200_000), "one", "left")
    found = found.join(broadcast_below(known.select(F.col("context").alias("two"), F.col("s").alias("s_two")), 200_000), "two", "left")
    own = scores.instances.where(F.col("target") == target).select("instance", F.col("s").alias("f"))
    return found.join(broadcast_below(own, 200_000), "instance", "left")


def _with_scores(found: DataFrame, scores: PiiScores, target: str) -> DataFrame:
    """found with c, the score of the longer context that says something, weak, whether it keeps others out, and f, the instance's score."""
    told, c = _scored(found, scores, target), F.coalesce("s_two", "s_one")
    return told.select(*[x for x in told.columns if x not in ("f", "s_two", "s_one")], F.coalesce(c, F.lit(0.0)).alias("c"), F.coalesce(c < 0.1, F.lit(False)).alias("weak"), F.coalesce("f", F.lit(0.0)).alias("f"))


def _people(tokens: DataFrame, scores: PiiScores, accept: float = 0.5, lone: float = 0.85) -> DataFrame:
    """(id, text_no, start_pos, end_pos) of persons, from the words of runs, the scores of their contexts (s_two) and of themselves (f).

    A run's words are listed or found names, initials, and others.  A name begins
    with a name or, where the context before it is strong, with another word;
    right before a name less strength is needed.
    """
    hopeful = _flag(64) | (F.coalesce("f", F.lit(0.0)) >= accept) | (F.coalesce("s_two", F.lit(0.0)) >= accept)
    runs = cut(_scored(tokens.select("text_no", "run", "instance", "two", "flags"), scores, "person").where(hopeful).select("text_no", "run").distinct())
    told = _scored(tokens.join(broadcast_below(runs, 500_000), ["text_no", "run"], "left_semi"), scores, "person")
    kind = F.when(_flag(64), "N").when(_flag(128), "i").when(_flag(256), "l").otherwise("C")
    words = F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", kind.alias("class"), "flags", "s_two", "f", _flag(8).alias("low"))))
    packed = told.groupBy("id", "text_no", "run").agg(words.alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, spans = [], []
            for i, words in enumerate(b.column(2).to_pylist()):
                k = 0
                kinds = ["N" if w["class"] in "Cl" and (w["f"] or 0.0) >= accept else w["class"] for w in words]
                while k < len(words):
                    first, w = k, words[k]
                    following = kinds[k + 1] if k + 1 < len(words) and not w["flags"] & 2 else ""
                    strength = w["s_two"] or 0.0
                    told = ""
                    if kinds[k] == "l" or (kinds[k] == "C" and (w["flags"] & 1 or strength < (accept if following in ("N", "i") else lone))):
                        k += 1
                        continue
                    if kinds[k] == "i" and following == "C" and strength >= accept:
                        told, k = "iC", k + 2
                    while k < len(words) and len(told) < 4 and (kinds[k] in "Ni" or (kinds[k] == "C" and told[:1] in ("", "C"))):
                        told += kinds[k]
                        k += 1
                    while told.endswith("i"):
                        told, k = told[:-1], k - 1
                    small = told in ("N", "iN") and words[k - 1]["low"]
                    if told and not (small and strength < accept):
                        owner.append(i)
                        spans.append((words[first]["start_pos"], words[k - 1]["end_pos"]))
                    k = max(k, first + 1)
            taken = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), *(pa.array([s[j] for s in spans], pa.int32()) for j in (0, 1))], ["id", "text_no", "start_pos", "end_pos"])

    key = tokens.schema["id"].dataType.simpleString()
    return packed.select("id", "text_no", "w").mapInArrow(run, f"id {key}, text_no long, start_pos int, end_pos int")


def _decided(found: DataFrame, scores: PiiScores, accept: float = 0.5) -> DataFrame:
    """(id, text_no, pii_kind, start_pos, end_pos) of the candidates that their scores accept, without overlaps."""
    place = ["id", "text_no", "start_pos", "end_pos"]
    # A known context that keeps others out outweighs any form but a seed's.
    value = F.when((F.col("c") >= 0.1) | (F.col("f") == 1.0) | ~F.col("weak"), F.col("c") + F.col("f")).otherwise(0.0)
    parts = []
    for target, kind in (("email", "email"), ("phone", "number"), ("id_number", "number"), ("address", "address")):
        told = _with_scores(found.where(F.col("kind") == kind), scores, target)
        parts.append(told.select(*place, F.lit(target).alias("pii_kind"), value.alias("value"), F.lit(0).alias("order")))
    # A street that no list names needs both: a context of streets and a word that stands in such contexts.
    broad = _with_scores(found.where("kind = 'broad'"), scores, "broad").where((F.col("c") >= 0.8) & (F.col("f") >= 0.75))
    parts.append(broad.select(*place, F.lit("address").alias("pii_kind"), (F.col("c") + F.col("f")).alias("value"), F.lit(1).alias("order")))
    strong = reduce(DataFrame.unionByName, parts).where(F.col("value") >= accept)
    people = _people(found.where("kind = 'person'"), scores, accept)
    every = strong.unionByName(people.select(*place, F.lit("person").alias("pii_kind"), F.lit(1.0).alias("value"), F.lit(2).alias("order")))
    # Of several that overlap the first in order stands: listed forms, then the higher score.
    grouped = every.groupBy("id", "text_no").agg(F.array_sort(F.collect_list(F.struct("order", (-F.col("value")).alias("less"), "start_pos", "end_pos", "pii_kind"))).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    free = F.aggregate("all", none, lambda kept, x: F.when(F.exists(kept, lambda y: (y.start_pos < x.end_pos) & (x.start_pos < y.end_pos)), kept).otherwise(F.concat(kept, F.array(x))))
    return grouped.select("id", "text_no", F.explode(free).alias("x")).select("id", "text_no", "x.pii_kind", "x.start_pos", "x.end_pos")


def _listed(name_list: DataFrame, most_parts: int = 1_000_000) -> set[str]:
    parts = [r[0] for r in name_list.select("name_part").where("name_part is not null").distinct().limit(most_parts + 1).collect()]
    if len(parts) > most_parts:
        raise ValueError(f"the list has more than {most_parts} name parts")
    return {canonical(p, casefold=True) for p in parts}


def find_personal_information(rows: DataFrame, name_list: DataFrame, *, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """(id, pii_kind, start_pos, end_pos): one row per occurrence, positions in code points of the text.

    One pass over all texts finds candidates; the graph of their contexts and
    instances is counted and scored over all of them, and joined back to decide.
    Null and empty texts have no occurrences; long texts are read whole; a null
    id keeps its rows; repeated rows repeat theirs; other columns are left out,
    so none can clash.
    """
    found = _candidates(rows, id_col, text_col, _listed(name_list))
    return _decided(found, score(found)).select(F.col("id").alias(id_col), "pii_kind", "start_pos", "end_pos")


def replace_personal_information(rows: DataFrame, name_list: DataFrame, *, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """(id, clean_text): each text with typed placeholders such as [EMAIL], all else unchanged; null stays null.

    Only texts that hold something meet what was found in them; ids may be null
    or repeat, as texts are joined by themselves.
    """
    distinct = cut(rows.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct().withColumn("text_id", F.monotonically_increasing_id()))
    found = find_personal_information(distinct, name_list, id_col="text_id").groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "pii_kind"))).alias("spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        return F.struct(F.concat(a.out, F.substring(F.col("text"), a["at"] + 1, x.start_pos - a["at"]), F.lit("["), F.upper(x.pii_kind), F.lit("]")).alias("out"), x.end_pos.alias("at"))

    clean = F.aggregate("spans", start, step, lambda a: F.concat(a.out, F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    cleaned = distinct.join(found, "text_id").select("text", clean.alias("clean"))
    needed = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return needed.join(cleaned, "text", "left").select(F.col("id").alias(id_col), F.coalesce("clean", "text").alias("clean_text"))

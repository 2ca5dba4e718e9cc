"""Typed names of outlets and people tied to their register: segment index, banded edit distance, written forms."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covertrace.llm.fold import fold, words
from covertrace.session import written

#: Most edits between a typed and a registered form; short forms allow fewer.
EDITS = 2
#: Entries of a register that are sent to the executors at once; larger registers are taken in blocks of about this many.
REGISTER_LIMIT = 200_000
#: A word in more than one of so many outlet names only says what kind of outlet it is.
KIND_SHARE = 40
#: What stands for no edits counted, and for no host met.
NO_EDITS, NO_HOST = 99, 9

# Articles and linking words of outlet names.
ARTICLES = frozenset("the le la les l el los las der die das den det de du des del of".split())
# Words added to an outlet's name for an edition or a company.
EDITIONS = frozenset("online web print edition digital epaper app com website net ltd inc gmbh ag aps sa as plc llc group media".split())
# Words before and after a byline's names.
BEFORE = frozenset("by von par af por fra de".split())
# Words that join two names.
_JOINED = re.compile(r"\s+(?:and|og|et|und|y|med|with|con|avec|mit|AND|OG|ET|UND)\s+|\s*[&/;|+]\s*")
# Short forms of European first names that aren't cut from them, with the names they stand for.
SHORT_FORMS = {
    "tom": "thomas tomas", "tommy": "thomas tomas", "sasha": "alexander alexandra aleksandr aleksandra", "sandy": "alexander alexandra", "alec": "alexander", "lex": "alexander", "bob": "robert", "bobby": "robert", "bill": "william", "billy": "william",
    "liam": "william", "wim": "willem wilhelm william", "dick": "richard", "rick": "richard frederick", "jack": "john", "johnny": "john", "hans": "johannes johann", "jan": "johannes johann", "jens": "johannes",
    "johan": "johannes", "jo": "johannes josephine joanna joseph", "joe": "joseph", "pepe": "jose josef", "pepito": "jose", "beppe": "giuseppe", "peppe": "giuseppe", "sepp": "josef", "jupp": "josef",
    "josie": "josephine", "fifi": "josephine", "paco": "francisco", "pancho": "francisco", "curro": "francisco", "kiko": "francisco enrique", "fran": "francisco francesca frances", "frank": "francisco franklin franz", "chico": "francisco",
    "lola": "dolores", "loli": "dolores", "lolita": "dolores", "nacho": "ignacio", "chema": "josemaria", "quique": "enrique", "kike": "enrique", "beto": "alberto roberto", "nando": "fernando", "lalo": "eduardo", "tono": "antonio",
    "toni": "antonio anton antonia", "tony": "anthony antonio anton", "chus": "jesus maria", "conchi": "concepcion", "concha": "concepcion", "charo": "rosario", "lupe": "guadalupe", "maite": "maria teresa", "manolo": "manuel", "memo": "guillermo",
    "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "greta": "margareta margarete margaret", "gretel": "margarete", "grethe": "margrethe", "polly": "mary", "molly": "mary", "sally": "sarah", "daisy": "margaret",
    "betty": "elisabeth elizabeth", "liz": "elisabeth elizabeth", "lisa": "elisabeth elizabeth", "lise": "elisabeth", "lizzie": "elisabeth elizabeth", "bess": "elizabeth", "elsa": "elisabeth", "libby": "elizabeth", "lis": "elisabeth", "liesl": "elisabeth",
    "kate": "katherine catherine katharina", "kathy": "katherine", "kitty": "katherine", "katie": "katherine", "kat": "katherine", "kay": "katherine", "kasia": "katarzyna", "katya": "ekaterina", "kaja": "karin katarina", "trine": "katrine",
    "kit": "christopher", "topher": "christopher", "stoffel": "christoph", "kris": "christopher christian", "xander": "alexander", "ted": "theodor theodore edward", "teddy": "theodor theodore edward", "ned": "edward", "ed": "edward edmund",
    "fritz": "friedrich", "frits": "frederik", "frede": "frederik", "fiete": "friedrich", "rik": "frederik ulrik", "uli": "ulrich ulrik", "ulli": "ulrich ulrik", "heinz": "heinrich", "heiner": "heinrich", "henk": "hendrik", "hank": "henry", "harry": "henry harold",
    "lasse": "lars", "lars": "laurits", "niels": "nicolas", "nils": "nicolas", "klaus": "nikolaus", "claus": "nicolaus", "nick": "nicolas nicholas", "colin": "nicolas", "jorg": "georg jurgen", "jurg": "jurgen", "jorn": "jurgen", "gorka": "jorge",
    "mats": "matthias", "mathis": "matthias", "hias": "matthias", "matze": "matthias", "matt": "matthias matthew", "misha": "mikhail michael", "mick": "michael", "mischa": "michael", "mimi": "maria", "mia": "maria", "mitzi": "maria", "gigi": "luigi",
    "hedda": "hedvig", "hedi": "hedwig hedvig", "hedy": "hedwig", "resi": "therese", "terri": "theresa", "sanne": "susanne", "sue": "susan susanne", "sanna": "susanna", "suzy": "susan susanne", "vicky": "victoria", "tori": "victoria", "vroni": "veronika",
    "gabby": "gabriele gabriella", "jim": "james", "jimmy": "james", "jake": "jacob", "jaap": "jacob", "chuck": "charles", "kalle": "karl", "carlo": "carlos", "lou": "louis louise", "lotte": "charlotte", "charlie": "charles charlotte", "yusuf": "joseph", "jusuf": "yusuf",
    "gianni": "giovanni", "vanni": "giovanni", "nino": "giovanni antonio", "mirek": "miroslav", "zdenek": "zdeno", "kuba": "jakub", "gosia": "malgorzata", "ola": "aleksandra", "asia": "joanna", "tomek": "tomasz", "vova": "vladimir", "dima": "dmitri", "kolya": "nikolai",
}
#: Endings that are put on a name cut short, as in Rosie, Benny, Hansi, Lottchen; letters a cut name keeps, at least.
ENDINGS, KEPT_LETTERS = ("", "y", "ie", "i", "o", "a", "e", "ey", "ke", "je", "chen", "ito", "ita", "sy", "ster"), 3


def shortens(short: str, full: str) -> bool:
    """Whether ``short`` may stand for the first name ``full``: cut from its start (with an ending) or its end, or a known short form."""
    if short == full or full in SHORT_FORMS.get(short, "").split():
        return short != full
    if len(short) >= 3 and (full.startswith(short) or (full.endswith(short) and len(full) - len(short) >= 2)):
        return True
    for ending in ENDINGS:
        stem = short[: len(short) - len(ending)] if ending and short.endswith(ending) else ""
        # a last consonant may be doubled, as in Benny, or hardened, as in Vicky
        for cut in (stem, stem[:-1] if len(stem) > 2 and (stem[-1] == stem[-2] or stem.endswith("ck")) else ""):
            if len(cut) >= KEPT_LETTERS and len(short) >= 3 and len(cut) < len(full) and full.startswith(cut):
                return True
    return False


def within(a: str, b: str, k: int) -> int:
    """Edit distance of ``a`` and ``b`` where it is at most ``k`` (neighbours swapped count as one edit), else ``k + 1``.

    Only the band of cells within ``k`` of the diagonal is filled.
    """
    if abs(len(a) - len(b)) > k:
        return k + 1
    big = k + 1
    before: list[int] = []
    row = [j if j <= k else big for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        older, before = before, row
        row = [big] * (len(b) + 1)
        if i <= k:
            row[0] = i
        ca = a[i - 1]
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            cb = b[j - 1]
            v = before[j - 1] if ca == cb else 1 + min(before[j - 1], before[j], row[j - 1])
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                v = min(v, older[j - 2] + 1)
            row[j] = v if v < big else big
        if min(row) > k:
            return big
    return row[-1]


def edits_for(form: str) -> int:
    """Edits that a form of this length allows."""
    return 0 if len(form) < 5 else 1 if len(form) < 8 else EDITS


class SegmentIndex:
    """Registered forms in an inverted index of their segments.

    Forms of different scopes (the contributors of one outlet) don't meet. A form is cut into two segments more than the edits it allows; of a typed form with no more edits one segment
    stands unchanged, shifted by no more than the edits. Swapped neighbours may damage two segments: one swap leaves one
    of them whole all the same; against two, each across a border, forms that allow two edits are cut a second time with
    every border moved by one, which no such swap crosses.
    """

    def __init__(self, forms: Iterable[tuple[str, int, int]]):
        self.exact: dict[tuple[int, str], set[int]] = defaultdict(set)
        self.segments: dict[tuple[int, int, int, str], list[tuple[str, int]]] = defaultdict(list)
        for form, owner, scope in forms:
            if form:
                self.exact[(scope, form)].add(owner)
        self.lengths: set[int] = set()
        for scope, form in self.exact:
            k = edits_for(form)
            if k:
                self.lengths.add(len(form))
                for s, (at, size) in enumerate(self.cuts(len(form), k)):
                    self.segments[(scope, len(form), s, form[at : at + size])].append((form, letters(form)))

    @staticmethod
    @cache
    def cuts(n: int, k: int) -> tuple[tuple[int, int], ...]:
        """(start, size) of k + 2 segments of nearly one size, and for two edits of as many with their borders moved by one."""
        parts = k + 2
        out, at = [], 0
        for s in range(parts):
            size = n // parts + (s >= parts - n % parts)
            out.append((at, size))
            at += size
        if k > 1:
            out += [(at + (at > 0), size + (at == 0) - (at + size == n)) for at, size in out]
        return tuple(out)

    def near(self, typed: str, scope: int = 0) -> dict[int, int]:
        """Owners of the forms of ``scope`` that ``typed`` may stand for, with the edits between them."""
        found: dict[int, int] = {o: 0 for o in self.exact.get((scope, typed), ())}
        seen: set[str] = set()
        own = letters(typed)
        for n in range(len(typed) - EDITS, len(typed) + EDITS + 1):
            if n not in self.lengths:
                continue
            k = 1 if n < 8 else EDITS
            for s, (at, size) in enumerate(self.cuts(n, k)):
                for start in range(max(0, at - k), min(len(typed) - size, at + k) + 1):
                    for form, held in self.segments.get((scope, n, s, typed[start : start + size]), ()):
                        # an edit changes at most two of the letters that stand in a form
                        if form not in seen and (own ^ held).bit_count() <= 2 * k:
                            seen.add(form)
                            d = within(typed, form, k)
                            if d <= k:
                                for o in self.exact[(scope, form)]:
                                    found[o] = min(d, found.get(o, NO_EDITS))
        return found


def letters(form: str) -> int:
    """A bit for each letter that stands in a form (one of 64)."""
    out = 0
    for ch in form:
        out |= 1 << (ord(ch) & 63)
    return out


def host_of(value: str | None) -> str:
    """The bare host of a URL or domain: no scheme, port, path, www., m. or amp.; '' for none."""
    if not value:
        return ""
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", value.strip().lower())
    host = re.split(r"[/?#]", host, maxsplit=1)[0].rpartition("@")[2].partition(":")[0]
    return re.sub(r"^(?:www\d?|m|amp|mobile)\.", "", host).rstrip(".")


def abbreviates(short: list[str], full: list[str]) -> bool:
    """Whether the words of ``short`` begin words of ``full``, each another one, in any order."""
    rest = list(full)
    for w in short:
        p = next((p for p in rest if w == p or len(w) > 2 and p.startswith(w)), None)
        if p is None:
            return False
        rest.remove(p)
    return True


class Registers:
    """Registered outlets and contributors in the forms under which they are looked up."""

    def __init__(self, outlets: list[tuple[int, str, str]], contributors: list[tuple[int, str, int]], kinds: frozenset[str] | None = None):
        self.name = {o: n or "" for o, n, _ in outlets}
        self.by_exact = {n: o for o, n, _ in outlets if n}
        self.host: dict[str, int] = {}
        self.has_host = set()
        self.parts: dict[int, list[str]] = {}
        self.all: dict[int, list[str]] = {}
        forms: list[tuple[str, int, int]] = []
        by_word: dict[str, set[int]] = defaultdict(set)
        by_initials: dict[str, set[int]] = defaultdict(set)
        for o, n, d in outlets:
            if host_of(d):
                self.host[host_of(d)] = o
                self.has_host.add(o)
            ws = words(n)
            core = [w for w in ws if w not in ARTICLES] or ws
            self.parts[o], self.all[o] = core, ws
            forms += [(form, o, 0) for form in {"".join(ws), "".join(core), "".join(reversed(core)), "".join(sorted(core))}]
            for w in core:
                by_word[w].add(o)
                if w.endswith("er"):  # the town in an adjective
                    by_word[w[:-2]].add(o)
            if len(ws) > 1:
                for chosen in (ws, core, [w for w in ws if w not in ("the", "le", "la", "el")]):
                    by_initials["".join(w[0] for w in chosen)].add(o)
        self.index = SegmentIndex(forms)
        self.by_word, self.by_initials = by_word, by_initials
        usage = Counter(w for core in self.parts.values() for w in set(core))
        self.kinds = frozenset(w for w, n in usage.items() if n > max(5, len(outlets) // KIND_SHARE)) if kinds is None else kinds
        self.people: dict[int, tuple[int, str, list[str]]] = {}  # contributor -> outlet, name, its words
        self.registered: set[tuple[int, str]] = set()
        whole, last = [], []
        for c, n, o in contributors:
            if n and o is not None and (ws := words(n)):
                self.people[c] = (o, n, ws)
                self.registered.add((o, n))
                whole += [(form, c, o) for form in {ws[0] + ws[-1], ws[-1] + ws[0], "".join(ws), ws[-1] + "".join(ws[:-1])}]
                last.append((ws[-1], c, o))
        self.whole_index, self.last_index = SegmentIndex(whole), SegmentIndex(last)
        self.outlet_cache: dict[tuple, int | None] = {}
        self.people_cache: dict[tuple, list[int]] = {}

    # -- outlets ------------------------------------------------------------------------------------------

    def _loose(self, raw: str, typed: list[str]) -> set[int]:
        """Outlets of which ``typed`` may be a short form: parts of the name, abbreviated words, initials, the town."""
        core = [w for w in typed if w not in ARTICLES] or typed
        found: set[int] = set()
        sets = [self.by_word.get(w, set()) for w in core]
        if all(sets):
            found |= set.intersection(*sets)
        if len(core) > 1:
            for o in set().union(*(self.by_word.get(w, set()) for w in core), *(self._starting(w) for w in core)):
                if abbreviates(core, self.parts[o]):
                    found.add(o)
        elif len(core[0]) <= 6 and raw.isupper():
            found |= self.by_initials.get(core[0], set())
        return found

    def _starting(self, w: str) -> set[int]:
        if len(w) < 3:
            return set()
        return set().union(*(os for word, os in self.by_word.items() if word.startswith(w)))

    def outlet(self, raw: str | None, domain: str | None, url: str | None) -> tuple[int | None, int | None]:
        """(outlet that the name refers to, outlet of the row); either may be None."""
        hosts = tuple(h for h in (host_of(domain), host_of(url)) if h)
        key = (raw, *hosts)
        if key not in self.outlet_cache:
            self.outlet_cache[key] = decided_outlet(raw, self.outlet_options(raw, hosts), self.kinds)
        return self.outlet_cache[key]

    def outlet_options(self, raw: str | None, hosts: tuple[str, ...]) -> list[tuple[int, bool, int, int, bool, bool, bool]]:
        """(outlet, exactly named, place of its host, edits, short form, close, host spells another name) of every outlet that may be meant."""
        home = next(((self.host[h], k) for k, h in enumerate(hosts) if h in self.host), None)
        typed = typed_words(raw)
        near: dict[int, int] = {}
        loose: set[int] = set()
        if typed:
            core = [w for w in typed if w not in ARTICLES] or typed
            for form in {"".join(typed), "".join(core), "".join(sorted(core))}:
                for o, d in self.index.near(form).items():
                    near[o] = min(d, near.get(o, NO_EDITS))
            loose = self._loose((raw or "").strip(), typed)
        exact = self.by_exact.get(raw)
        out = []
        for o in sorted(near.keys() | loose | ({home[0]} if home else set()) | ({exact} if exact is not None else set())):
            at = home[1] if home and home[0] == o else NO_HOST
            out.append((o, o == exact, at, near.get(o, NO_EDITS), o in loose, at < NO_HOST and bool(typed) and self._close(typed, o), bool(typed) and self._own_host(typed, list(hosts), o)))
        return out

    def _close(self, typed: list[str], home: int) -> bool:
        """Whether a long name is within one edit more of the outlet that its host names."""
        name = "".join(self.parts[home])
        if len(name) < 10:
            return False
        forms = ("".join(typed), "".join(w for w in typed if w not in ARTICLES))
        return any(within(f, n, EDITS + 1) <= EDITS + 1 for f in forms for n in (name, "".join(self.all[home])))

    def _own_host(self, typed: list[str], hosts: list[str], candidate: int) -> bool:
        """Whether a host spells the typed name itself: then the name is right, and of an outlet outside the register."""
        if candidate not in self.has_host:
            return False
        names = {"".join(typed), "".join(w for w in typed if w not in ARTICLES)}
        return any(re.sub(r"[^a-z0-9]", "", h.rpartition(".")[0]) in names for h in hosts)

    # -- people -------------------------------------------------------------------------------------------

    def persons(self, raw: str | None, outlet: int | None) -> list[int]:
        """Contributors of ``outlet`` named in a byline that isn't just one registered name."""
        if not raw or outlet is None:
            return []
        key = (raw, outlet)
        if key not in self.people_cache:
            self.people_cache[key] = decided_persons(self.person_options(raw, outlet))
        return self.people_cache[key]

    def person_options(self, raw: str, outlet: int) -> list[tuple[int, int, int]]:
        """(part of the byline, contributor, how far from it) of every contributor of ``outlet`` that may be meant; part -1 for a registered name."""
        if (outlet, raw) in self.registered:
            return [(-1, 0, 0)]
        out = []
        for k, part in enumerate(_JOINED.split(raw.strip())):
            part = part.strip()
            if "@" in part:
                part = part.partition("@")[0].replace(".", " ").replace("_", " ")
            lead, _, rest = part.partition(",")
            least: dict[int, int] = {}
            for reading in [lead, f"{rest} {lead}"] if rest else [lead]:
                typed = words(reading)
                while len(typed) > 2 and typed[0] in BEFORE:
                    typed = typed[1:]
                for c, score in self._person_scores(typed, outlet):
                    least[c] = min(score, least.get(c, score))
            out += [(k, c, score) for c, score in least.items()]
        return out

    def _person_scores(self, typed: list[str], outlet: int) -> Iterator[tuple[int, int]]:
        """(contributor of ``outlet``, how far a typed name is from theirs): whole names by the segments, others by the last name's."""
        full = [w for w in typed if len(w) > 1]
        single = [w for w in typed if len(w) == 1]
        for form in {"".join(full), "".join(typed)} - {""}:
            yield from self.whole_index.near(form, outlet).items()
        if len(full) == 1 and single:
            for c, d in self.last_index.near(full[0], outlet).items():
                if single[0] == self.people[c][2][0][0] and d <= 1:
                    yield c, 3 + d
        if len(full) == 2:
            for first, last in (full, full[::-1]):
                for c, d in self.last_index.near(last, outlet).items():
                    if shortens(first, self.people[c][2][0]):
                        yield c, 3 + d


def typed_words(raw: str | None) -> list[str]:
    """The words of a typed outlet name without what an edition or company adds."""
    typed = words(raw)
    while len(typed) > 1 and typed[-1] in EDITIONS:
        typed.pop()
    return typed


def decided_outlet(raw: str | None, options: list[tuple], kinds: frozenset[str]) -> tuple[int | None, int | None]:
    """(outlet that the name refers to, outlet of the row) out of the options; either may be None."""
    exact = [o[0] for o in options if o[1]]
    if exact:
        return max(exact), max(exact)
    host = min((o for o in options if o[2] < NO_HOST), key=lambda o: (o[2], -o[0]), default=None)
    home = host[0] if host else None
    typed = typed_words(raw)
    if not typed:
        return None, home
    if host and (host[3] < NO_EDITS or host[4] or host[5]):
        return home, home
    best = min((o[3] for o in options), default=NO_EDITS)
    named = [o for o in options if o[3] == best]
    loose = [o for o in options if o[4]]
    if best < NO_EDITS:
        if len(named) == 1 and (best == 0 or (home is None and not named[0][6])):
            return named[0][0], named[0][0]
    elif len(loose) == 1 and home is None and not loose[0][6] and not all(w in kinds for w in [w for w in typed if w not in ARTICLES] or typed):
        return loose[0][0], loose[0][0]
    return None, home


def decided_persons(options: list[tuple]) -> list[int]:
    """The nearest contributor of each part of a byline, where it is one; none for a registered name."""
    if any(part < 0 for part, _, _ in options):
        return []
    found: dict[int, None] = {}
    for part in sorted({p for p, _, _ in options}):
        own = [(score, c) for p, c, score in options if p == part]
        winners = {c for score, c in own if score == min(own)[0]}
        if len(winners) == 1:
            found[winners.pop()] = None
    return list(found)


FOUND = "row_id long, field_name string, entity_id long"


def tied_names(rows: DataFrame, outlets: DataFrame, contributors: DataFrame) -> DataFrame:
    """(row_id, field_name, entity_id): typed outlet names and bylines that refer to a registered entry without being it.

    An outlet is looked up by its name's forms in the segment index, then by short forms (parts, abbreviated
    words, initials, the town); the row's domain or URL decides between several. A person is looked up in segment indexes
    of whole and last names, among the contributors of the row's outlet: any order, initials, short first names, addresses, edits, added words; a
    byline of two names gives a row each. Null and blank values, unknown names and ties that nothing decides give
    no row; repeated rows come out as often as they stand. Registers of up to ``REGISTER_LIMIT`` entries are sent to the
    executors and rows are read once, without a shuffle; larger ones go through ``tied_in_blocks``, with the same result.
    """
    named = outlets.select("id", "name", "domain").where("id is not null")
    people = contributors.select("contributor_id", "full_name", "outlet_id").where("contributor_id is not null")
    if any(r.limit(REGISTER_LIMIT + 1).count() > REGISTER_LIMIT for r in (named, people)):
        return tied_in_blocks(rows, named, people)
    sent = rows.sparkSession.sparkContext.broadcast(([tuple(r) for r in named.orderBy("id").collect()], [tuple(r) for r in people.orderBy("contributor_id").collect()]))

    def tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registers = Registers(*sent.value)
        for pdf in batches:
            out = []
            for row, name, domain, url, byline in zip(pdf["row_id"], pdf["outlet_name"], pdf["outlet_domain"], pdf["url"], pdf["byline"]):
                outlet, home = registers.outlet(name, domain, url)
                if outlet is not None and registers.name[outlet] != name:
                    out.append((row, "outlet_name", outlet))
                out += [(row, "byline", c) for c in registers.persons(byline, home)]
            if len(registers.people_cache) + len(registers.outlet_cache) > 500_000:
                registers.people_cache.clear()
                registers.outlet_cache.clear()
            yield pd.DataFrame(out, columns=["row_id", "field_name", "entity_id"])

    wanted = rows.select("row_id", "outlet_name", "outlet_domain", "url", "byline").where(F.col("row_id").isNotNull())
    return wanted.mapInPandas(tie, FOUND)


_OUTLET_OPTION = "name string, hosts array<string>, o struct<id:bigint,exact:boolean,host:int,edits:int,loose:boolean,close:boolean,other:boolean>, registered string"
_PERSON_OPTION = "outlet bigint, byline string, o struct<part:int,id:bigint,score:int>"


@F.pandas_udf(T.ArrayType(T.StringType()))
def hosts_of(domain: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([[h for h in (host_of(d), host_of(u)) if h] for d, u in zip(domain, url)])


def tied_in_blocks(rows: DataFrame, outlets: DataFrame, people: DataFrame) -> DataFrame:
    """``tied_names`` for registers of any size.

    The distinct typed names meet the register in blocks chosen by a hash of the id, each small enough to be sent; what
    the blocks offer is drawn together by name and decided as a whole.
    """
    spark = rows.sparkSession
    wanted = written(rows.select("row_id", "outlet_name", hosts_of("outlet_domain", "url").alias("hosts"), "byline").where(F.col("row_id").isNotNull()))
    total = outlets.count()
    usage = outlets.mapInPandas(_name_words, "w string").groupBy("w").count().where(F.col("count") > max(5, total // KIND_SHARE))
    kinds = frozenset(r[0] for r in usage.collect())  # at most KIND_SHARE for each word of a name

    def blocks(register: DataFrame, key: str) -> Iterator[list[tuple]]:
        parts = max(1, -(-2 * register.count() // REGISTER_LIMIT))
        for k in range(parts):
            yield [tuple(r) for r in register.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k).orderBy(key).collect()]

    def united(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    names = written(wanted.select(F.col("outlet_name").alias("name"), "hosts").distinct())
    offers = []
    for block in blocks(outlets, "id"):
        sent = spark.sparkContext.broadcast(block)

        def offer(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            registers = Registers(sent.value, [], kinds)
            for pdf in batches:
                out = [(n, list(h), o, registers.name[o[0]]) for n, h in zip(pdf["name"], pdf["hosts"]) for o in registers.outlet_options(n, tuple(h))]
                yield pd.DataFrame(out, columns=["name", "hosts", "o", "registered"])

        offers.append(written(names.mapInPandas(offer, _OUTLET_OPTION)))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, hosts, found in zip(pdf["name"], pdf["hosts"], pdf["found"]):
                options = [tuple(x["o"][c] for c in ("id", "exact", "host", "edits", "loose", "close", "other")) for x in found]
                outlet, home = decided_outlet(name, options, kinds)
                differs = outlet is not None and next(x["registered"] for x in found if x["o"]["id"] == outlet) != name
                out.append((name, list(hosts), outlet if differs else None, home))
            yield pd.DataFrame(out, columns=["name", "hosts", "outlet", "home"]).astype({"outlet": "Int64", "home": "Int64"})

    decided = written(united(offers).groupBy("name", "hosts").agg(F.collect_list(F.struct("o", "registered")).alias("found")).mapInPandas(decide, "name string, hosts array<string>, outlet bigint, home bigint"))
    placed = written(wanted.join(decided, wanted["outlet_name"].eqNullSafe(decided["name"]) & (wanted["hosts"] == decided["hosts"])).select("row_id", "outlet", "home", "byline"))
    bylines = written(placed.where("home is not null and byline <> ''").select(F.col("home").alias("outlet"), "byline").distinct())
    offers = []
    for block in blocks(people, "contributor_id"):
        sent = spark.sparkContext.broadcast(block)

        def offer_people(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            registers = Registers([], sent.value, kinds)
            for pdf in batches:
                yield pd.DataFrame([(o, b, x) for o, b in zip(pdf["outlet"], pdf["byline"]) for x in registers.person_options(b, o)], columns=["outlet", "byline", "o"])

        offers.append(written(bylines.mapInPandas(offer_people, _PERSON_OPTION)))

    def decide_people(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(o, b, c) for o, b, found in zip(pdf["outlet"], pdf["byline"], pdf["found"]) for c in decided_persons([(x["part"], x["id"], x["score"]) for x in found])]
            yield pd.DataFrame(out, columns=["home", "byline", "entity_id"])

    persons = united(offers).groupBy("outlet", "byline").agg(F.collect_list("o").alias("found")).mapInPandas(decide_people, "home bigint, byline string, entity_id bigint")
    by_outlet = placed.where("outlet is not null").select("row_id", F.lit("outlet_name").alias("field_name"), F.col("outlet").alias("entity_id"))
    return by_outlet.unionByName(placed.join(persons, ["home", "byline"]).select("row_id", F.lit("byline").alias("field_name"), "entity_id"))


def _name_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"w": [w for n in pdf["name"] for w in {x for x in words(n) if x not in ARTICLES}]})

"""Secret scan: fixed patterns, and strings that a primed compressor finds new.

Three patterns give the base spans. Beside them, every run of key characters
within reach of a sensitive word is a candidate: zstandard is primed with an
identifier dictionary and the text around the candidate, and the candidate's
marginal bytes are what it adds to the compressed size. Identifiers and prose
repeat what stands around them or in the dictionary; a random key does not. Long
candidates are measured in overlapping pieces of ``PIECE`` characters, and one
with a piece of ``NOVELTY`` bytes a character or more is reported whole as
``novel``. Whole texts are scanned; a candidate's surroundings are bounded.

Cases: a null text counts as empty and has no spans; overlapping spans of
different kinds are all reported, but a novel span never overlaps another (of a
candidate that a base span overlaps, the rest is reported); extra
columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from hashloom.llm import textbuf as tb
from hashloom.llm.shared import bounded, texts

KINDS = ("assign", "access", "hex", "novel")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(f"(?:{'|'.join(map(_either, _WORDS[:4]))}|{_either('api')}_?{_either('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
#: Sensitive words, and runs of key characters; '=' ends a run, and belongs to it only as padding.
_NEAR = re.compile(r"secret|token|passw|passphrase|api.?key|access.?key|private.?key|credential|bearer|authorization|signature", re.ASCII | re.IGNORECASE)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
_NEAR_WORDS = ("secret", "token", "passw", "passphrase", "key", "credential", "bearer", "authorization", "signature")
#: A run is a candidate up to so many characters of the same line behind a sensitive word, and has so many characters at least.
REACH, LEAST = 40, 16
#: Marginal compressed bytes a character from which a candidate is reported; characters of its surroundings on each side.
NOVELTY, AROUND = 0.85, 512
#: Characters of a piece, of which the next has half: below 64 literals zstandard stores them plain, so size tells repetition and not the alphabet.
PIECE = 32
#: Lower case, as candidates and their surroundings are when they are measured: letters alone do not tell a key from a long word.
IDENTIFIERS = (
    b"able ably ance ation ational ations ative ment ments ness ship ship tion tions sion ity ities ability ibility ization isation ology ological ography graphic graphical istic istically ously fully "
    b"inter counter electro micro macro trans super under over multi photo psycho thermo hydro bio geo neuro cardio socio infra ultra hyper anti auto semi non dis mis pre pro con com "
    b"international national rational characteristic responsible responsibility representative communication recommendation consideration understanding approximately simultaneously extraordinary "
    b"circumstances accomplishment acknowledgement administration advertisement consequently constitutional controversial correspondence demonstration determination development differentiation discrimination "
    b"embarrassment encouragement entertainment environmental establishment exceptionally experimental independent individual industrial institutional intellectual interpretation investigation "
    b"jurisdiction manufacturing mathematical misunderstanding neighbourhood notwithstanding opportunity organization participation pharmaceutical philosophical possibility predominantly professional psychological qualification reconstruction rehabilitation reinforcement revolutionary significant sophisticated specification straightforward straight forward telecommunication temperature traditional transformation transportation uncomfortable unfortunately universal vulnerability "
    b"sicherheit einstellung einstellungen verwaltung gesellschaft wissenschaft wissenschaftlich versicherung entwicklung verantwortung verantwortlich geschwindigkeit zusammen arbeit unternehmen bundes regierung minister landes haupt freund freundlich schaft lich lichkeit keit heit ungen ung benutzer anmelde daten bank kennwort passwort schutz grund ordnung beziehung selbst verst unter wirtschaft zwischen stellung leistung rechts versammlung aufmerksam konto name zeit "
    b"responsabilit internationaux gouvernement fonctionnement environnement particuli renseignement enseignement etablissement developpement ement ements eusement ellement iquement configuraci informaci administraci responsabilidad desarrollo conocimiento funcionamiento comportamiento procedimiento establecimiento amiento imiento aciones mente caracter autentica contrase usuario seguridad motdepasse utilisateur "
    b"abstract access account action active adapter address agent algorithm alias annotation apache application argument array assertion async attribute auth authentic authentication authenticator authorize backend base batch block boolean broker buffer builder bundle cache callback cancel catalog certificate chain channel check class client cluster code collection column command comment commit common compile component computer config configuration connect connection console constant container content context control controller convert cookie core count crypto current custom data database datetime debug decode default definition delegate delete deploy description device dialog directory dispatcher document documentation domain download driver dynamic element email encode encoder encryption endpoint engine entity entry error event example exception exchange execute executor expire export expression extension factory failure feature field file filter folder format framework function gateway generator global group handler hash header helper history home host html http https identifier identity image implementation import include index initialize input instance integration interceptor interface internal invalid iterator java javascript json kernel label language layer library lifecycle link linux list listener loader local location lock logger login machine manager mapper master memory message metadata method middleware migration mobile model module monitor mutable native navigation network node notification number object observer operation option order organization origin output package packages page parameter parent parser partner path pattern payload performance permission persist pipeline platform plugin policy pool port prefix primary private process processor profile program project property protocol provider proxy public python query queue random reader record recovery redirect reference refresh register registry release remote render replace report repository request require resolver resource response result return rotation route router runtime sample schedule scheduler schema scope script search section security segment select sequence serial serializer server service services session setting settings shared signature simple singleton site size socket software source spring standard start state static status storage store strategy stream string structure style subscriber subscription suffix support switch symbol system table target task template temporary test text thread time timeout timestamp trace tracker traffic transaction transfer transform type undefined unique update upload user username utility valid validate validation validator value variable vendor verification version view virtual visitor web widget window worker workflow workspace wrapper write writer xml zone "
    b"usr/local/lib/ /usr/share/ /var/log/ /etc/ /home/ /opt/ site-packages dist-packages src/main/java/ src/test/ org/ com/ www github gitlab google amazon amazonaws microsoft azure docs/ api/v1/ v2/ static/assets/images/ wiki/ index html blob/master/ tree/main/ node_modules us-east-1 eu-west-1 "
    b"password passwd secret token api_key apikey access_key private_key credential credentials bearer authorization signature "
    b"username account config settings default example placeholder changeme production development environment your_ my_ here "
    b"aws_secret_access_key aws_access_key_id client_secret client_id refresh_token session_token access_token database_url begin end rsa public_key "
    b"abcdefghijklmnopqrstuvwxyz 0123456789 1234567890 0000000000000000 xxxxxxxxxxxxxxxx ################ "
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order of start and kind."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes of the candidate, by its characters; all in lower case."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + after.lower().encode() + b"\n" + before.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=12, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return (len(packer.compress(candidate.lower().encode())) - len(packer.compress(b""))) / len(candidate)


def novel(text: str, a: int, b: int) -> bool:
    """Whether a piece of the run is novel, beside what stands before the piece and behind the run."""
    after, seen = text[b : b + AROUND], set()
    for k in (*range(a, b - PIECE, PIECE // 2), max(a, b - PIECE)):
        piece = text[k : min(k + PIECE, b)]
        if piece not in seen and novelty(piece, text[max(0, k - AROUND) : k], after) >= NOVELTY:
            return True
        seen.add(piece)
    return False


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters within reach of a sensitive word; of a run that has the word in itself, what follows the word."""
    out, near = [], [m.end() for m in _NEAR.finditer(text)]
    k = 0
    for m in _RUN.finditer(text) if near else ():
        a, b = m.span()
        while k < len(near) and near[k] <= a:
            k += 1
        if not (k and a - near[k - 1] <= REACH and "\n" not in text[near[k - 1] : a]):
            if k == len(near) or near[k] > b:
                continue
            a = near[k]
            while a < b and text[a] in "+/_-":
                a += 1
        if b - a >= LEAST:
            out.append((a, b))
    return out


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans and novel ones, in order."""
    out = base_spans(text)
    low = text.lower()
    if not any(w in low for w in _NEAR_WORDS):
        return out
    base = list(out)
    for a, b in candidates(text):
        parts, at = [], a  # a base span inside a key does not hide the rest of the key
        for s, _, e in base:
            if s < b and at < e:
                parts.append((at, s))
                at = e
        parts = [(x, y) for x, y in (*parts, (at, b)) if x < y]
        if parts and novel(text, a, b):
            out += [(x, 3, y) for x, y in parts]
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                found = [all_spans(t) for t in part.column("text").fill_null("").to_pylist()]
                counts = [pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64()) for kind in range(4)]
                sha = [hashlib.sha256(_joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(sha), pa.array([_joined(s) for s in found])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact_text(text: str, mask: str = "[redacted]") -> str:
    """The text with every span replaced by the mask (overlapping spans by one)."""
    out, at = [], 0
    for a, _, b in all_spans(text):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[redacted]") -> DataFrame:
    """The documents with their secrets masked; n_chars, where there is such a column, follows the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                texts = [None if t is None else redact_text(t, mask) for t in part.column("text").to_pylist()]
                columns = {f.name: part.column(f.name) for f in part.schema} | {"text": pa.array(texts, part.schema.field("text").type)}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return bounded(docs).mapInArrow(run, docs.schema)

"""The newly written text of emails, decoded by a semi-Markov model over their lines."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ship

# Kinds of span.
AUTHORED, QUOTED, FORWARDED, SIGNATURE, DISCLAIMER, HEADER = range(6)

#: Bound of the sample from which the words of disclaimers are learnt: flagged passages, and as many bodies.
SAMPLE = 2000

# Cues in the languages of mail programs and writers.
VERBS = "wrote|said|writes|escreveu|disse|escribió|escribio|dijo|a écrit|a ecrit|écrit|schrieb|geschrieben|ha scritto|scrisse|schreef|geschreven"
FIELDS = ("from|sent|to|cc|bcc|subject|date|reply-to|de|enviado|enviado em|enviado el|para|assunto|asunto|data|fecha|von|gesendet|an|betreff|datum|"
          "envoyé|envoye|à|a|objet|da|inviato|oggetto|van|verzonden|aan|onderwerp|importance")
FORWARD = ("original message|forwarded message|begin forwarded|mensagem original|mensagem encaminhada|mensaje original|mensaje reenviado|ursprüngliche nachricht|weitergeleitete nachricht|"
           "anfang der weitergeleiteten|message d'origine|message original|message transféré|début du message|inicio del mensaje|início da mensagem|messaggio originale|messaggio inoltrato|oorspronkelijk bericht|doorgestuurd bericht")
CLOSINGS = ("kind regards|best regards|regards|warm regards|with best regards|yours sincerely|yours faithfully|yours truly|sincerely|best wishes|best|cheers|thanks|many thanks|thank you|thanks and regards|"
            "atenciosamente|cordialmente|abraços|abraço|um abraço|obrigado|obrigada|grato|grata|saudações|cumprimentos|com os melhores cumprimentos|atentamente|saludos|saludos cordiales|un saludo|un cordial saludo|"
            "gracias|muchas gracias|mit freundlichen grüßen|mit freundlichem gruß|freundliche grüße|viele grüße|beste grüße|liebe grüße|herzliche grüße|grüße|gruß|danke|danke und gruß|vielen dank|mfg|"
            "cordialement|bien cordialement|bien à vous|merci|merci d'avance|salutations|meilleures salutations|salutations distinguées|sincères salutations|cordiali saluti|distinti saluti|saluti|grazie|"
            "met vriendelijke groet|met vriendelijke groeten|groeten|vriendelijke groet|bedankt|dank u")
DEVICE = (r"sent from|sent via|get outlook|enviado (?:do|da|de|desde|a partir)|envoyé (?:de|depuis)|von (?:unterwegs|meinem|meiner) |gesendet (?:von|mit)|von .{0,30}gesendet|inviato da|verzonden (?:vanaf|met|via)|verstuurd vanaf")
POSTSCRIPT = r"p\.? ?s\.?|p\.? ?d\.?|p\.? ?p\.? ?s\.?|nachtrag|post scriptum"
DISCLAIMER_WORDS = ("confidentiality confidential privileged disclaimer addressee recipient intended prohibited unauthorised unauthorized registered virus printing imprimir imprimer drucken confidencialidad sigilo "
                    "confidentialité vertraulichkeitshinweis vertraulich destinatario destinataire empfänger remetente remitente expéditeur absender registergericht handelsregister siège sitz domicilio sede")

_MARK = re.compile(r"^[ \t]{0,3}(?:[>|]+[ \t]?)+")
_FIELD = re.compile(rf"^\*?(?:{FIELDS})\s*:\*?(?:\s|$)", re.I)
_FORWARD = re.compile(rf"^[-_=\s*>]*(?:{FORWARD})\b[^.]{{0,30}}$", re.I)
_FORWARD_RULE = re.compile(r"^-{3,}\s*\w[\w' ]{2,50}\s*-{3,}\s*$")
_VERB = re.compile(rf"\b(?:{VERBS})\b", re.I)
_DATE = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\b\d{1,2} \w{3,10}\.? \d{4}\b|\b\w{3,10} \d{1,2}, \d{4}\b")
_EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_URL = re.compile(r"^(?:https?://|www\.)\S+$", re.I)
_INNER_STOP = re.compile(r"[.!?…]\s+[^\W\d_a-zà-öø-ÿ]")
_CLOSING = re.compile(rf"^(?:{CLOSINGS})(?:[ ,]+(?:{CLOSINGS}))?\s*[,.!]?$", re.I)
_DEVICE = re.compile(rf"^(?:{DEVICE})", re.I)
_POST = re.compile(rf"^(?:{POSTSCRIPT})\s*[:.\-–]?\s", re.I)
_POST_SIGN = re.compile(r"^(?:P\. ?-? ?S|PS|P\. ?D|PD|P\.? ?P\.? ?S)\b")
_RULE = re.compile(r"^[-–—_=*~#+. ]{2,}$")
_PHONE = re.compile(r"^(?:\w{1,12}\.?\s*:?\s*)?\+?[\d(][\d\s()./-]{6,}$")
_FINAL = re.compile(r"[.!?…:]['\"»”“)]*\s*$")
_WORDS = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"\n[^\S\n]*\n")
_GREETING = re.compile(r"^(?:hi|hello|dear|good|hey|bom|boa|boas|ol[áa]|prezad\w*|car[oa]s?|buen\w+|hola|estimad\w+|guten|hallo|lieb\w*|sehr|bonjour|bonsoir|cher\w*|ch[eè]re\w*|salut|ciao|gentil\w*|beste|geachte)\b", re.I)


@dataclass
class Line:
    """A line of a mail: where it stands, its text without marks, and whether it is marked as quoted."""

    section: int
    passage: int
    number: int
    text: str
    marked: bool
    flagged: bool


@dataclass
class Block:
    """Lines between which no span may end."""

    lines: list[Line]
    marked: bool = False
    after_blank: bool = True
    kind: str = ""
    scores: list[float] = field(default_factory=list)
    closing: int = 0
    contact: int = 0
    named: int = 0
    post: bool = False


def lines_of(sections: list) -> list[Line]:
    """The lines of a mail in order; null sections, passages and empty ones have none or blank lines."""
    out = []
    for s, section in enumerate(sections if sections is not None else []):
        if section is None:
            continue
        passages = section.get("passages")
        for p, passage in enumerate(passages if passages is not None else []):
            for n, raw in enumerate((passage or "").split("\n")):
                raw = raw.replace("﻿", "").replace("​", "").replace("\xa0", " ").rstrip()
                m = _MARK.match(raw)
                marked = bool(m) and (raw.lstrip()[:1] in ">|")
                out.append(Line(s, p, n, (raw[m.end() :] if m else raw).strip(), marked, section.get("boilerplate") is True))
    return out


class Introductions:
    """Where introductions of quotations end. One ends in a colon, names a writing verb at most six words before it and a date or an address,
    and is one sentence, over however many lines without a blank or marked one or a header field. Each line is walked over once, whatever its text."""

    def __init__(self, lines: list[Line]):
        self.lines = lines
        self.ends = [-1] * len(lines)  # the line with the colon that a sentence from this line reaches
        self.failed: set[int] = set()  # such lines that no sentence from further down can fit
        for j, line in enumerate(lines):
            if line.marked or not line.text.endswith(":") or _INNER_STOP.search(line.text.rstrip(":")):
                continue
            self.ends[j] = j
            for i in range(j - 1, -1, -1):
                x = lines[i]
                if not x.text or x.marked or x.text.endswith(":") or _FIELD.match(x.text) or _FORWARD.match(x.text) or _FORWARD_RULE.match(x.text) or _INNER_STOP.search(f"{x.text} {lines[i + 1].text}".rstrip(":")):
                    break
                self.ends[i] = j

    def end(self, i: int) -> int:
        """The last line of the introduction that begins at line i, or -1."""
        j = self.ends[i]
        if j < 0 or j in self.failed:
            return -1
        text = " ".join(x.text for x in self.lines[i : j + 1])
        verbs = [m.end() for m in _VERB.finditer(text)]
        if verbs and len(_WORDS.findall(text, verbs[-1])) <= 6 and (_DATE.search(text) or _EMAIL.search(text)):
            return j
        self.failed.add(j)  # less text can't do either
        return -1


def blocks_of(lines: list[Line]) -> list[Block]:
    """Blocks: runs of lines between blank lines, changes of mark, and lines with a cue that can begin or end a span."""
    out: list[Block] = []
    introductions = Introductions(lines)
    blank, i, n = True, 0, len(lines)
    while i < n:
        line = lines[i]
        if i and (line.passage, line.section) != (lines[i - 1].passage, lines[i - 1].section):
            blank = True
        if not line.text and not line.marked:
            blank = True
            i += 1
            continue
        last = out[-1] if out and not blank else None
        if not line.marked:
            end = introductions.end(i) if last is None or last.marked or last.kind or i and lines[i - 1].passage != line.passage or _EMAIL.search(line.text) or line.text.startswith("--") else -1
            if end >= 0:
                out.append(Block(lines[i : end + 1], False, blank, "intro"))
                i, blank = end + 1, False
                continue
            kind = "forward" if _FORWARD.match(line.text) or _FORWARD_RULE.match(line.text) else "field" if _FIELD.match(line.text) else ""
            if kind == "field" and not (last and last.kind == "field"):
                # one field alone is no header of a message
                nxt = [x.text for x in lines[i + 1 : i + 4] if x.text][:1]
                if not (nxt and _FIELD.match(nxt[0])):
                    kind = ""
            if last and not last.marked and last.kind == kind and not (kind == "" and (_CLOSING.match(line.text) or _POST_SIGN.match(line.text) or _DEVICE.match(line.text) or (line.flagged != last.lines[-1].flagged) or (line.section != last.lines[-1].section))):
                last.lines.append(line)
            elif last and last.kind == "field" and kind == "" and line.text and lines[i - 1].text and _EMAIL.fullmatch(line.text.strip("<>")):
                last.lines.append(line)  # a wrapped field
            else:
                out.append(Block([line], False, blank, kind))
        elif last and last.marked:
            last.lines.append(line)
        else:
            out.append(Block([line], True, blank))
        blank = False
        i += 1
    return out


class Model:
    """Scores of spans. ``weights``: log-odds of words in disclaimers against other text."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights if weights is not None else {}
        for w in DISCLAIMER_WORDS.split():
            self.weights[w] = max(self.weights.get(w, 0.0), 1.5)

    def disclaimer(self, text: str) -> float:
        """Mean log-odds of the words, for spans of any wrapping."""
        words = [w.lower() for w in _WORDS.findall(text)]
        if not words:
            return 0.0
        return max(-6.0, min(10.0, sum(self.weights.get(w, -0.8) for w in words) / max(8, len(words)) * 6))

    def score_blocks(self, blocks: list[Block], sender: str | None) -> None:
        """The score of each block as part of a span of each kind."""
        local = re.sub(r"[^a-z]", "", (sender or "").split("@")[0].lower())
        n = len(blocks)
        only_fields = True
        for k, b in enumerate(blocks):
            texts = [x.text for x in b.lines if x.text]
            words = sum(len(_WORDS.findall(t)) for t in texts)
            s = [0.0] * 6
            before, after = blocks[k - 1] if k else None, blocks[k + 1] if k + 1 < n else None
            if b.marked:
                s[AUTHORED], s[QUOTED], s[FORWARDED], s[SIGNATURE], s[DISCLAIMER], s[HEADER] = -12.0, 10.0, 10.0, -12.0, -12.0, -12.0
                b.scores = s
                only_fields = False
                continue
            s[QUOTED] = -10.0
            s[HEADER] = -10.0
            if b.kind == "intro":
                followed = any(x.marked for x in blocks[k + 1 : k + 3])
                s[AUTHORED], s[QUOTED], s[FORWARDED], s[SIGNATURE], s[DISCLAIMER] = -7.0, 8.0 if followed else -10.0, 8.0 if followed else 0.5, -10.0, -10.0
            elif b.kind == "forward":
                s[AUTHORED], s[FORWARDED], s[SIGNATURE], s[DISCLAIMER] = -9.0, 1.0, -8.0, -8.0
                if after and after.marked:
                    s[QUOTED] = 8.0
            elif b.kind == "field":
                s[AUTHORED], s[FORWARDED], s[SIGNATURE], s[DISCLAIMER] = -7.0, 1.0, -6.0, -8.0
                if only_fields:
                    fields = " ".join(texts).lower()
                    s[HEADER] = 9.0 if not sender or sender.lower() in fields or not _EMAIL.search(fields) else -5.0
            else:
                flagged = any(x.flagged for x in b.lines)
                text = " ".join(t for t in texts if not _RULE.match(t))
                d = self.disclaimer(text)
                s[DISCLAIMER] = d + (20.0 if flagged else 0.0)
                first = texts[0]
                b.post = bool(_POST_SIGN.match(first))
                own, sign = 1.0 + 0.3 * min(len(texts), 5), 0.0
                if b.post:
                    own += 6.0
                elif _GREETING.match(first) and len(first) < 50:
                    own += 2.0
                for j, t in enumerate(texts):
                    count = len(_WORDS.findall(t))
                    letters = re.sub(r"[^a-z]", "", t.lower())
                    if _CLOSING.match(t) and j <= 1:
                        b.closing += 1
                        sign += 5.0
                    elif _RULE.match(t):
                        sign += 1.5 if len(texts) > 1 or t.strip() in ("--", "—", "–") else 0.5
                        own -= 1.5
                        if t.strip() == "--":
                            b.contact += 1
                    elif _DEVICE.match(t) and count <= 14:
                        b.contact += 1
                        sign += 7.0
                        own -= 4.0
                    elif _EMAIL.fullmatch(t) or _URL.match(t) or _PHONE.match(t) and not _DATE.search(t):
                        b.contact += 1
                        sign += 4.0
                        own -= 3.0
                    elif count <= 4 and letters and local and len(letters) >= 3 and (letters in local or local in letters or _ordered(t, local)):
                        b.named += 1
                        sign += 5.0
                        own -= 2.0
                    elif count <= 6 and not _FINAL.search(t) and len(t) < 60:
                        sign += 0.7
                    else:
                        sign -= 5.0 if _FINAL.search(t) or count > 8 else 2.5
                if all(_RULE.match(t) for t in texts):
                    own -= 4.0
                s[AUTHORED] = own - max(0.0, d) - (6.0 if b.closing and not _GREETING.match(first) else 0.0) - (20.0 if flagged else 0.0)
                s[SIGNATURE] = sign - (4.0 if b.post else 0.0)
                # what a badly wrapped quotation leaves without its mark
                if not b.after_blank and before is not None and before.marked and first[:1] not in "-*•" and not _GREETING.match(first):
                    tight = after is not None and after.marked and not after.after_blank
                    if tight or not _FINAL.search(before.lines[-1].text) and (first[:1].islower() or not first[:1].isalpha() or len(texts) == 1 and len(first) < 0.5 * max(10, len(before.lines[-1].text))):
                        s[QUOTED] = 9.0 if tight else 6.0
                        s[AUTHORED] -= 2.0
                # an earlier message holds what any mail holds
                s[FORWARDED] = max(s[AUTHORED], s[SIGNATURE], s[DISCLAIMER], s[QUOTED], 0.0) + 0.3
            only_fields = only_fields and b.kind == "field"
            b.scores = s

    def decode(self, blocks: list[Block]) -> list[int]:
        """The kind of each block: the best sequence of spans. A span's score is that of its blocks, of how it begins and ends, of its length
        and of the whole of it.

        Spans of any length are weighed in time linear in the blocks: of each kind the open spans are carried on as long as the rest of the
        mail can tell them apart. Those are the best authored, quoted and header span; a forwarded one just begun and the best older one; and
        for signatures and disclaimers the best span of each number of lines up to that from which every further line costs the same, and,
        for signatures, of each set of parts (closing, name, contact) seen in it."""
        n = len(blocks)
        if not n:
            return []
        ended: list[list[Span]] = [[NO_SPAN] * 6]
        plain = [NO_SPAN] * 6  # open spans that need no more than their score
        fresh, more = NO_SPAN, 0.0  # a forwarded message's first block, and what a second one adds
        signatures: dict[tuple[int, int], Span] = {}
        disclaimers: dict[int, Span] = {}
        for k, b in enumerate(blocks):
            s, size = b.scores, len(b.lines)
            if k:
                enter = []
                for y in range(6):
                    way = NO_SPAN
                    for x in range(6):
                        v = ended[k][x][0]
                        if x != y and v > -math.inf:
                            if not (b.post and y == AUTHORED and x in (SIGNATURE, DISCLAIMER)):
                                v += _STEPS[x][y]
                            if v > way[0]:
                                way = (v, k, x)
                    enter.append(way)
            else:
                enter = [(0.0, 0, -1)] * 6
            for y in (AUTHORED, QUOTED):
                plain[y] = grown(enter[y] if enter[y][0] >= plain[y][0] else plain[y], s[y])
            plain[HEADER] = grown(enter[HEADER] if not k else plain[HEADER], s[HEADER])
            older = max(plain[FORWARDED], grown(fresh, more), key=lambda x: (x[0], x[1]))
            plain[FORWARDED] = grown(older, s[FORWARDED])
            fresh = NO_SPAN
            if b.kind in ("intro", "forward", "field"):
                begin, more = 7.0, 0.0
                if b.kind == "intro":
                    if any(x.marked for x in blocks[k + 1 : k + 3]):
                        begin = -18.0
                    else:
                        begin, more = 1.0, 6.0
                if not k and b.scores[HEADER] > 0:
                    begin -= 20.0
                fresh = grown(enter[FORWARDED], s[FORWARDED] + begin)
            parts = (1 if b.closing else 0) | (2 if b.named else 0) | (4 if b.contact else 0)
            open_now = {(min(size, 9), parts): grown(enter[SIGNATURE], s[SIGNATURE] - 0.7 * max(0, size - 9))}
            begun = open_now[min(size, 9), parts][0]
            for (z, held), span in signatures.items():
                span, key = grown(span, s[SIGNATURE] - 0.7 * max(0, z + size - 9)), (min(z + size, 9), held | parts)
                # one with no more parts than that which begins here, and no better, is never better
                if not (span[0] <= begun and held | parts == parts) and span[0] > open_now.get(key, NO_SPAN)[0]:
                    open_now[key] = span
            signatures = open_now
            open_parts = {min(size, 8): grown(enter[DISCLAIMER], s[DISCLAIMER] - 0.4 * max(0, size - 8))}
            begun = open_parts[min(size, 8)][0]
            for z, span in disclaimers.items():
                span = grown(span, s[DISCLAIMER] - 0.4 * max(0, z + size - 8))
                if span[0] > begun and span[0] > open_parts.get(min(z + size, 8), NO_SPAN)[0]:
                    open_parts[min(z + size, 8)] = span
            disclaimers = open_parts
            # what ends after this block
            after = blocks[k + 1] if k + 1 < n else None
            ends = list(plain)
            best = max(plain[FORWARDED], fresh, key=lambda x: (x[0], x[1]))
            # it runs to the end of the mail, or to what the mail system adds
            ends[FORWARDED] = grown(best, 0.0 if after is None else -3.0 if after.scores[DISCLAIMER] > 2 else -12.0)
            cut = 0.0 if after is None or after.marked or after.kind or after.post or after.scores[DISCLAIMER] > 1 else -1.5
            ends[SIGNATURE] = max((grown(span, cut + (-6.0 if not held else 2.0 if held & 3 == 3 else 0.0)) for (_, held), span in signatures.items()), key=lambda x: (x[0], x[1]))
            ends[DISCLAIMER] = max(disclaimers.values(), key=lambda x: (x[0], x[1]))
            ended.append(ends)
        out = [AUTHORED] * n
        y = max(range(6), key=lambda z: ended[n][z][0])
        end = n
        while end:
            _, start, x = ended[end][y]
            out[start:end] = [y] * (end - start)
            end, y = start, x
        return out

    def authored(self, sections: list, sender: str | None) -> list[tuple[int, int, int, str]]:
        """(section, passage, line, text) of each newly written line."""
        blocks = blocks_of(lines_of(sections))
        self.score_blocks(blocks, sender)
        kinds = self.decode(blocks)
        return [(x.section, x.passage, x.number, x.text) for b, k in zip(blocks, kinds) if k == AUTHORED for x in b.lines if x.text]


#: Log-odds of one kind of span following another.
_STEP = {
    (AUTHORED, DISCLAIMER): -0.5, (SIGNATURE, AUTHORED): -3.0, (DISCLAIMER, AUTHORED): -3.0, (DISCLAIMER, SIGNATURE): -1.0, (FORWARDED, AUTHORED): -12.0, (FORWARDED, SIGNATURE): -12.0,
    (FORWARDED, QUOTED): -12.0, (QUOTED, SIGNATURE): -0.5, (QUOTED, FORWARDED): -2.0, (AUTHORED, HEADER): -20.0, (QUOTED, DISCLAIMER): -0.5,
}


_STEPS = [[_STEP.get((x, y), 0.0) for y in range(6)] for x in range(6)]

#: A span: its score with all before it, the block it begins with, the kind of the span before.
Span = tuple[float, int, int]
NO_SPAN: Span = (-math.inf, -1, -1)


def grown(span: Span, by: float) -> Span:
    return span[0] + by, span[1], span[2]


def _ordered(text: str, local: str) -> bool:
    """Whether the words of a short line, in order, make up the sender's name."""
    at = 0
    words = [re.sub(r"[^a-z]", "", w.lower()) for w in text.split()]
    words = [w for w in words if len(w) >= 3]
    for w in words:
        at = local.find(w, at)
        if at < 0:
            return False
        at += len(w)
    return bool(words)


def learn_disclaimers(df: DataFrame, sample: int = SAMPLE) -> Model:
    """A model whose words are weighed by how much more often they stand in sections flagged as boilerplate than in others.

    At most about ``sample`` sections of either kind are read, whole, chosen by the hash of the mail's id; flags may be missing, never wrong. As
    sections without a flag hold disclaimers too, words are counted twice: paragraphs that the first weights take for disclaimers are left
    out of the second count. Only the counts of the sample's words come to the driver."""
    flagged = df.select("id", F.explode("sections").alias("s")).select("id", F.col("s.boilerplate").alias("flag"), F.concat_ws("\n", "s.passages").alias("text"))
    flagged = flagged.where(F.length("text") > 0).withColumn("flag", F.coalesce("flag", F.lit(False)))
    counts = {r["flag"]: r["n"] for r in flagged.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(True):
        return Model()
    unit = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = keep(flagged.where((F.col("flag") & (unit < min(1.0, sample / counts[True]))) | (~F.col("flag") & (unit < min(1.0, sample / max(1, counts.get(False, 1)))))).select("flag", "text"))
    model = None
    for _ in range(2):
        weights = model.weights if model else None

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
            known = Model(weights) if weights else None
            for part in parts:
                for flag, text in part.itertuples(index=False):
                    for paragraph in _BLANK.split(text):
                        lines = [x for x in paragraph.split("\n") if not _MARK.match(x) and not _FIELD.match(x)]
                        if lines and (flag or known is None or known.disclaimer(" ".join(lines)) <= 1.0):
                            seen[flag].update(w.lower() for x in lines for w in _WORDS.findall(x))
            yield pd.DataFrame([(flag, w, n) for flag, words in seen.items() for w, n in words.items()], columns=["flag", "w", "n"])

        seen: dict[bool, dict[str, int]] = {True: {}, False: {}}
        for r in chosen.mapInPandas(run, "flag boolean, w string, n bigint").groupBy("flag", "w").agg(F.sum("n").alias("n")).collect():
            seen[r["flag"]][r["w"]] = r["n"]
        a, b = sum(seen[True].values()) + 1.0, sum(seen[False].values()) + 1.0
        words = set(seen[True]) | set(seen[False])
        model = Model({w: max(-4.0, min(4.0, math.log((seen[True].get(w, 0) + 0.3) / (a + 100)) - math.log((seen[False].get(w, 0) + 0.3) / (b + 100)))) for w in words})
    chosen.unpersist()
    return model


_READY: dict[str, Model] = {}


def newly_written(df: DataFrame, id_col: str = "id", sections_col: str = "sections", sender_col: str = "sender") -> DataFrame:
    """(id, section_no, passage_no, line_no, text) of every newly written line of the mails in df.

    A map over the mails after a model of disclaimers has been learnt; only that model, of bounded size, is sent to the executors. A null
    sender, null sections or passages and empty texts are allowed and give no lines of their own; repeated mails give repeated lines."""
    ship(df.sparkSession)
    renamed = df.select(F.col(id_col).alias("id"), F.col(sections_col).alias("sections"), F.col(sender_col).alias("sender"))
    sent = df.sparkSession.sparkContext.broadcast((uuid4().hex, learn_disclaimers(renamed.select("id", "sections")).weights))
    kind = df.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, weights = sent.value
        if name not in _READY:
            _READY.clear()
            _READY[name] = Model(weights)
        model = _READY[name]
        for part in parts:
            rows = [(i, *line) for i, sections, sender in zip(part["id"], part["sections"], part["sender"]) for line in model.authored(sections, sender)]
            yield pd.DataFrame(rows, columns=["id", "section_no", "passage_no", "line_no", "text"])

    return renamed.mapInPandas(run, f"id {kind}, section_no bigint, passage_no bigint, line_no bigint, text string")

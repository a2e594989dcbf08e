"""Gradient-boosted trees that judge candidate spans, and where their examples come from.

No public spans are at hand, so examples are generated: formats of personal
data and of what looks like them (dates, prices, versions, ranges, words, paths,
identifiers of code), in sentences that do or do not speak of them.  Training
takes a second and depends on the seed only.
"""

from __future__ import annotations

import functools
import math
import random
import re
from dataclasses import dataclass, field

#: Beginnings of well-known keys, and words that speak of the kinds.
PREFIX = r"^(?:AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk-|sk_live_|AIza|eyJ)"
NEAR_PHONE = r"(?:phone|tel|mobile|call|fax|cell|whatsapp|telefon|handy|anruf|tél|appel|móvil|llam)"
NEAR_SECRET = r"(?:password|passwd|pwd|token|secret|api.?key|access.?key|credential|bearer|passwort|mot de passe|contraseña)"
NEAR_IDENTITY = r"(?:ssn|social|iban|account|konto|compte|cuenta|passport|tax)"

NEAR_HASH = r"(?:commit|md5|sha-?[0-9]|hash|checksum|digest|etag|revision|uuid|base64|changeset|integrity)"
SSN = r"^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$"

NAMES = ("chars", "digits", "upper", "lower", "separators", "switches", "hex", "bracket", "prefix", "assigned", "near_phone", "near_secret", "near_identity", "after_slash", "near_hash", "ssn", "goes_on", "generator")


def measured(value: str, before: str, generator: int, after: str = "") -> dict[str, float]:
    """The features of pii.features(), for training and for tests."""
    low = before.lower()
    return {
        "chars": float(len(value)),
        "digits": float(len(re.findall("[0-9]", value))),
        "upper": float(len(re.findall("[A-Z]", value))),
        "lower": float(len(re.findall("[a-z]", value))),
        "separators": float(len(re.findall("[ .()-]", value))),
        "switches": float(len(re.findall("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", value))),
        "hex": float(bool(re.search(r"^[0-9a-f]+\Z", value))),
        "bracket": float("(" in value),
        "prefix": float(bool(re.search(PREFIX, value))),
        "assigned": float(bool(re.search("[:=]", value))),
        "near_phone": float(bool(re.search(NEAR_PHONE, low))),
        "near_secret": float(bool(re.search(NEAR_SECRET, low))),
        "near_identity": float(bool(re.search(NEAR_IDENTITY, low))),
        "after_slash": float(bool(re.search(r"[/.#@]\Z", before))),
        "near_hash": float(bool(re.search(NEAR_HASH, low + " " + after.lower()))),
        "ssn": float(bool(re.search(SSN, value))),
        "goes_on": float(bool(re.search(r"^[/.@:%][A-Za-z0-9]", after))),
        "generator": float(generator),
    }


@dataclass
class Model:
    """Trees are leaves (floats) or (feature, at most, lower branch, upper branch)."""

    trees: list = field(default_factory=list)
    base: float = 0.0
    slope: dict[str, float] = field(default_factory=dict)
    shift: dict[str, float] = field(default_factory=dict)
    threshold: dict[str, float] = field(default_factory=dict)

    def raw(self, x: dict[str, float]) -> float:
        total = self.base
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if x[node[0]] <= node[1] else node[3]
            total += node
        return total

    def probability(self, kind: str, x: dict[str, float]) -> float:
        return 1 / (1 + math.exp(-(self.slope[kind] * self.raw(x) + self.shift[kind])))


def examples(seed: int, n: int) -> list[tuple[str, dict[str, float], int]]:
    """(kind, features, whether it is personal data or a secret)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    of = lambda s, k: "".join(r.choice(s) for _ in range(k))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: of(lower, r.randint(2, 9))
    plain = lambda: " ".join(word() for _ in range(8))[-r.randint(20, 39) :] + " "
    says = lambda words: plain()[: r.randint(5, 25)] + r.choice(words) + r.choice([" ", ": ", " is "])
    phone_words, secret_words, identity_words = ["phone", "tel", "call", "mobile", "fax", "Telefon"], ["password", "token", "secret", "api key", "credential"], ["ssn", "social security", "iban", "account", "konto"]
    out = []

    def put(kind: str, generator: int, value: str, before: str, yes: bool) -> None:
        out.append((kind, measured(value, before, generator), int(yes)))

    for _ in range(n):
        context = says(phone_words) if r.random() < 0.5 else plain()
        phone = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}"])
        put("phone", 0, phone, says(phone_words) if " " in phone and "(" not in phone else context, True)
        near = r.choice([f"{d(4)}-{r.randint(10, 12)}-{d(4)}"[:14], f"{d(3)} {d(3)} {d(3)}", f"{r.randint(10, 31)}.{r.randint(10, 12)}.{d(4)}", f"{d(2)} {d(3)} {d(3)}", f"{d(4)} {d(4)} {d(4)}", f"19{d(2)}-20{d(2)}-{d(4)}"])
        put("phone", 0, near, plain(), False)
        put("phone", 0, phone, plain()[:-1] + r.choice("/.#"), False)

        key = r.choice(["AKIA" + of(upper + digits, 16), "AKIA" + of(upper + digits, 16), "ghp_" + of(upper + lower + digits, 36), "sk-" + of(lower + upper + digits, 40), "xoxb-" + of(lower + upper + digits, 30), of(upper + lower + digits, r.randint(24, 64))])
        put("secret", 1, key, says(secret_words) + r.choice(["= \"", "", ""]) if r.random() < 0.6 else plain(), True)
        bare = of(digits + "abcdef", r.choice([32, 40, 64]))
        put("secret", 1, bare, plain()[: r.randint(5, 25)] + r.choice(["commit ", "md5 ", "sha256:", "hash ", "checksum "]), False)
        hexed = of(digits + "abcdef", r.choice([16, 18, 20, 24]))
        put("secret", 1, hexed, says(secret_words), True)
        dull = r.choice([of(lower, r.randint(16, 40)), of(upper, r.randint(16, 40)), d(r.randint(16, 30)), "-".join(word() for _ in range(4)) + "-word-form", "_".join(word() for _ in range(4)) + "_names", "/".join(word() for _ in range(4)) + "/path/to", "=" * r.randint(16, 60), "-" * r.randint(16, 60), of(lower, 14) + d(2), of(upper, 1) + of(lower, 17), "".join(word().capitalize() for _ in range(5)), "-".join(of(digits + "abcdef", k) for k in (8, 4, 4, 4, 12)), "-".join(of(digits + "abcdef", k) for k in (8, 4, 4, 4, 12)), "chapter-" + d(2) + "-section-" + d(2)])
        put("secret", 1, dull, plain() if r.random() < 0.9 else says(secret_words), False)

        name = r.choice(["password", "token", "secret", "api_key", "Password", "Token", "access_key"])
        value = r.choice([of(digits + "abcdef", r.randint(12, 40)), of(upper + lower + digits, r.randint(8, 40)), of(lower, 5) + d(3) + "!"])
        put("secret", 2, name + r.choice(["=", ": ", " = ", "="]) + r.choice(["", '"']) + value, plain(), True)
        put("secret", 2, name + r.choice([": ", "=", " = "]) + r.choice([of(lower, r.randint(6, 16)), "the" + of(lower, 5), of(lower, 9) + ","]), plain(), False)

        ssn = f"{d(3)}-{d(2)}-{d(4)}"
        put("ssn", 3, ssn, says(identity_words) if r.random() < 0.7 else plain(), True)
        put("phone", 0, f"{d(3)}-{d(2)}-{d(4)}", says(identity_words) if r.random() < 0.5 else plain(), False)
        put("ssn", 3, f"{d(3)} {d(2)} {d(4)}", plain(), False)
        put("ssn", 3, ssn, plain()[:-1] + r.choice("/.#"), False)
        country = r.choice(["DE", "FR", "ES", "GB", "IT", "NL"]) + d(2)
        put("iban", 4, country + d(r.randint(12, 20)) if r.random() < 0.5 else country + "".join(" " + d(4) for _ in range(r.randint(3, 5))) + " " + d(2), says(identity_words) if r.random() < 0.6 else plain(), True)
        put("iban", 4, of(upper, 2) + d(2) + of(upper, r.randint(8, 20)), plain(), False)
        put("iban", 4, of(upper, 2) + d(2) + " " + of(upper, 4) + " " + of(upper, 4), plain(), False)
    return out


def unlike(seed: int, n: int) -> list[tuple[str, dict[str, float], int]]:
    """Examples of another generator: other formats, sentences, surroundings and shares, for calibration and tests.

    Some cannot be told from one another, as in texts: the same number is a
    phone or a part number, the same digits a secret or a checksum.
    """
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    of = lambda s, k: "".join(r.choice(s) for _ in range(k))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = "the report of last week shows that our house by the river was sold in march and nobody knows why it rained".split()
    plain = lambda: " ".join(r.choice(words) for _ in range(9))[-39:] + " "
    said = lambda *w: " ".join(r.choice(words) for _ in range(4))[-20:] + " " + r.choice(w) + " "
    out = []

    def put(kind: str, generator: int, value: str, before: str, yes: bool, after: str = " and so on") -> None:
        out.append((kind, measured(value, before, generator, after), int(yes)))

    for _ in range(n):
        put("phone", 0, r.choice([f"({d(3)}) {d(3)} {d(4)}", f"0{d(2)}-{d(4)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]), said("reach me on my mobile", "call us at", "fax no.", "Telefon") if r.random() < 0.7 else plain(), True)
        put("phone", 0, r.choice([f"{d(4)}-{d(2)}-{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}"]), plain(), False)
        if r.random() < 0.1:
            put("phone", 0, f"{d(3)}-{d(3)}-{d(4)}", said("part", "order", "case"), False)
        put("secret", 1, r.choice(["AKIA", "ghp_", "xoxb-", "AIza", "sk_live_"]) + of(b64[:62], r.randint(16, 80)), said("export", "use", "the token") if r.random() < 0.5 else plain(), True)
        put("secret", 1, of("0123456789abcdef", r.choice([32, 40, 48])), said("token =", "api key:", "secret is"), True)
        put("secret", 1, of("0123456789abcdef", r.choice([32, 40, 64])), said("commit", "md5", "sha256 of it:", "etag"), False)
        if r.random() < 0.3:
            put("secret", 1, of("0123456789abcdef", 40), plain(), r.random() < 0.3)
        put("secret", 1, r.choice(["/".join(r.choice(words) for _ in range(6)), "-".join(r.choice(words) for _ in range(5)), "_".join(r.choice(words) for _ in range(5)) + "_" + d(3), "".join(w.capitalize() for w in r.choices(words, k=5)) + "Manager", d(r.randint(16, 22)), f"{of('0123456789abcdef', 8)}-{of('0123456789abcdef', 4)}-4{of('0123456789abcdef', 3)}-a{of('0123456789abcdef', 3)}-{of('0123456789abcdef', 12)}"]), plain(), False)
        put("secret", 2, r.choice(["password", "api_key", "TOKEN", "secret"]) + r.choice([": ", "=", " = "]) + of(b64[:62], r.randint(10, 60)), plain(), True)
        put("secret", 2, r.choice(["Password", "token", "secret"]) + ": " + r.choice(words) + r.choice(words), plain(), False)
        put("ssn", 3, f"{d(3)}-{d(2)}-{d(4)}", said("SSN", "social security number", "tax id") if r.random() < 0.8 else plain(), True)
        put("ssn", 3, f"{d(3)} {d(2)} {d(4)}", plain(), False)
        put("iban", 4, r.choice(["DE", "FR", "AT", "CH", "BE"]) + d(2) + r.choice(["", " "]).join(["", *(d(4) for _ in range(r.randint(3, 5)))]), said("IBAN", "our account", "Konto") if r.random() < 0.8 else plain(), True)
        put("iban", 4, of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2) + d(2) + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r.randint(8, 20)), plain(), False)
    return out


def boosted(rows: list[tuple[dict[str, float], int]], rounds: int = 40, depth: int = 3, rate: float = 0.4, least: int = 12) -> tuple[float, list]:
    """Gradient boosting of the logistic loss; splits are tried at every midpoint of up to 16 quantiles."""
    import numpy as np

    x = np.array([[a[n] for n in NAMES] for a, _ in rows])
    y = np.array([b for _, b in rows], float)
    base = math.log(y.mean() / (1 - y.mean()))
    score = np.full(len(y), base)
    cuts = []
    for k in range(x.shape[1]):
        v = np.unique(x[:, k])
        mids = (v[1:] + v[:-1]) / 2
        cuts.append(mids if len(mids) <= 16 else np.unique(np.quantile(mids, np.linspace(0, 1, 16))))

    def grow(rows_in, g, h, level):
        total_g, total_h = g[rows_in].sum(), h[rows_in].sum()
        best = (1e-6, None)
        if level < depth:
            for k, at_all in enumerate(cuts):
                column = x[rows_in, k]
                for at in at_all:
                    low = column <= at
                    n = int(low.sum())
                    if n < least or len(rows_in) - n < least:
                        continue
                    gl, hl = g[rows_in][low].sum(), h[rows_in][low].sum()
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0]:
                        best = (gain, (k, at))
        if best[1] is None:
            return round(float(rate * total_g / (total_h + 1)), 6)
        k, at = best[1]
        low = x[rows_in, k] <= at
        return (NAMES[k], float(at), grow(rows_in[low], g, h, level + 1), grow(rows_in[~low], g, h, level + 1))

    def value(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[NAMES.index(node[0])] <= node[1] else node[3]
        return node

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), 0)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        score += np.array([value(tree, row) for row in x])
    return round(base, 6), trees


def calibrated(model: Model, rows: list[tuple[str, dict[str, float], int]], precision: float = 0.97) -> None:
    """Platt's scaling for each kind on examples not trained on, and the least threshold at which the accepted ones reach the precision."""
    import numpy as np

    for kind in dict.fromkeys(k for k, _, _ in rows):
        z = np.array([model.raw(x) for k, x, _ in rows if k == kind])
        y = np.array([t for k, _, t in rows if k == kind], float)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([(z * (p - y)).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
            h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
            if abs(step).max() < 1e-8:
                break
        model.slope[kind], model.shift[kind] = round(a, 6), round(b, 6)
        p = 1 / (1 + np.exp(-(model.slope[kind] * z + model.shift[kind])))
        order = np.argsort(-p, kind="stable")
        share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        # a threshold stands between two probabilities: all of one probability are accepted, or none
        last = np.append(p[order][1:] < p[order][:-1] - 1e-9, True)
        good = np.flatnonzero((share >= precision) & last)
        if len(good):
            at, floor = good[-1], p[order][good[-1] + 1] if good[-1] + 1 < len(y) else 0.0
            model.threshold[kind] = round(float((p[order][at] + floor) / 2), 4)
        else:
            model.threshold[kind] = 1.1


@functools.cache
def trained(seed: int = 5) -> Model:
    base, trees = boosted([(x, t) for _, x, t in examples(seed, 150)])
    model = Model(trees, base)
    calibrated(model, unlike(seed + 1, 300))
    return model

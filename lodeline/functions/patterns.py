"""Token classes, masks, and the regular expressions behind them, made fit for the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

WILDCARD = "<*>"

# The classes of variable tokens, in the order in which a token is classified and a line is masked.
CLASSES = {
    "TIMESTAMP": r"\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?",
    "IPV4": r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b",
    "UUID": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "HEX": r"\b0x[0-9a-fA-F]+\b",
    "LOGLEVEL": r"\b(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\b",
    "PATH": r"(?<!\S)/[A-Za-z0-9_.\-/]+",
    "NUMBER": r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])",
}
# The same classes for whole tokens.
WHOLE = {
    "TIMESTAMP": r"\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?",
    "IPV4": r"(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?",
    "UUID": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "HEX": r"0x[0-9a-fA-F]+",
    "LOGLEVEL": r"(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)",
    "PATH": r"/[A-Za-z0-9_.\-/]+",
    "NUMBER": r"-?\d+(?:\.\d+)?",
}
# Classes that offline synthesis adds where a sampled token shows them.
EXTRA = {
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "URL": r"https?://[^\s]+",
    "MAC": r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b",
}
# What every match of a class holds: these strings, and whether a digit.
HOLDS = {
    "TIMESTAMP": ((":",), True),
    "IPV4": ((".",), True),
    "UUID": (("-",), False),
    "HEX": (("0x",), False),
    "PATH": (("/",), False),
    "NUMBER": ((), True),
    "EMAIL": (("@", "."), False),
    "URL": (("://",), False),
    "MAC": ((":",), False),
}
CORE = ("TIMESTAMP", "LOGLEVEL", "NUMBER", "IPV4")
OPTIONAL = ("EMAIL", "HEX", "MAC", "PATH", "URL", "UUID")


@dataclass(frozen=True)
class Mask:
    label: str
    pattern: str
    justification: str = ""

    @staticmethod
    def of(x: Mask | Mapping[str, str], strict: bool = False) -> Mask:
        """A mask from a mask or mapping; strict: all three keys and no other."""
        if isinstance(x, Mask):
            return x
        if strict and set(x) != {"label", "pattern", "justification"}:
            raise TypeError(f"a mask has label, pattern and justification, not {sorted(x)}")
        return Mask(x["label"], x["pattern"], x.get("justification") or "")

    def as_dict(self) -> dict[str, str]:
        return asdict(self)

    @property
    def placeholder(self) -> str:
        return f"<VAR:{re.sub('[^A-Z0-9]', '', self.label.upper()) or 'VAR'}>"

    @property
    def java(self) -> str:
        """The pattern for the JVM: groups lose their names, and classes are Unicode's as they are in Python."""
        return "(?U)" + re.sub(r"\(\?P<\w+>", "(", self.pattern)


def holds(mask: Mask) -> tuple[tuple[str, ...], bool]:
    """Strings that every match of the mask holds, and whether it holds a digit: known for the patterns of the classes, nothing for others."""
    return next((HOLDS[label] for label in HOLDS if (CLASSES.get(label) or EXTRA[label]) == mask.pattern), ((), False))


def canonical_masks() -> list[Mask]:
    return [Mask(label, pattern, f"canonical class {label}") for label, pattern in CLASSES.items()]


def class_patterns() -> dict[str, str]:
    """Whole-token patterns by class name, in classification order."""
    return {name: f"^{pattern}$" for name, pattern in WHOLE.items()}


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark's regular expressions, which are the JVM's, take the pattern. No job runs."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def usable(spark: SparkSession, masks: Iterable[Mask | Mapping[str, str]]) -> list[Mask]:
    """The masks that can be compiled, in order; others are left out, as a line can't be masked by them."""
    return [m for m in map(Mask.of, masks) if compiles(spark, m.java)]


def validate_patterns(patterns: Iterable[str], strict: bool = False) -> list[str]:
    """The patterns, if all compile and, with strict, none holds `.*`; else ValueError."""
    found = list(patterns)
    for p in found:
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"invalid pattern {p!r}: {e}") from e
        if strict and ".*" in p:
            raise ValueError(f"pattern {p!r} is too wide")
    return found

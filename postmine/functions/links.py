"""Finding links and their domains in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmine.functions.text import SPACE_CLASS

# They decide which results come out.
# Schemes, and the top-level domains that make a link.
SCHEMES = "https?|ftp"
TOP_LEVEL_DOMAINS = "de|com|net|org|nl|ca|co\\.uk|co|ly|le|in|es"
# The older pattern, in which the bracketed lists are sets of single characters.
# Word characters are spelled out because \w is ASCII only here.
CLASS_PATTERN = (
    r"[http:\/\/|ftp:\/\/|https:\/\/]*[www\.]*([\p{L}\p{N}_-]++)"
    r"\.[de|com|net|org|nl|ca|co\.uk|co|ly|le|in|es]"
    r"[\p{L}\p{N}_?=%&/#]*[\p{L}\p{N}_@?^=%&\/~+#-]"
)

# Both modes start a match only where no earlier character could have started it. The links
# are the same, but a long unbroken run is read once instead of once per character. Repeated
# groups are possessive, since others recurse and overflow on long runs.
LABEL = r"[\p{L}\p{N}_-]"
TLD_END = rf"\.(?:{TOP_LEVEL_DOMAINS})(?![\p{{L}}\p{{N}}_])"
COMPAT_PATTERN = rf"(?:(?<!{LABEL})|\G|(?=[htpfsw]*+[:/|.]))" + CLASS_PATTERN

# A chain of labels, with the path if the chain ends in a top-level domain. A label that runs
# into :// belongs to the next link, but for a top-level domain set off by a hyphen.
CHAIN_PATTERN = (
    rf"(?:(?:{SCHEMES})://|(?<!{LABEL})(?<!{LABEL}\.)){LABEL}++"
    rf"(?:\.(?:(?:{TOP_LEVEL_DOMAINS})(?=-{LABEL}*+://)|{LABEL}++(?!://)))++"
    rf"(?:(?<={LABEL}\.(?:{TOP_LEVEL_DOMAINS}))[/?#][^{SPACE_CLASS}]*+)?"
)
# The part of a chain that is a link, up to its last top-level domain; group 1 is the domain.
LINK_PATTERN = (
    rf"^(?:(?:{SCHEMES})://)?+(?:[\p{{L}}\p{{N}}_.-]*\.)?({LABEL}++){TLD_END}(?:[/?#][^{SPACE_CLASS}]*+)?"
)

MODES = ("strict", "compat")


def links(text: Column, mode: str = "strict") -> Column:
    """All links in order of appearance, repeats kept; null text gives none."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "compat":
        found = F.regexp_extract_all(text, F.lit(COMPAT_PATTERN), F.lit(0))
    else:
        chains = F.regexp_extract_all(text, F.lit(CHAIN_PATTERN), F.lit(0))
        cut = F.transform(chains, lambda chain: F.regexp_extract(chain, LINK_PATTERN, 0))
        found = F.filter(cut, lambda link: link != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def domain_of(link: Column, mode: str = "strict") -> Column:
    """The domain of one link that :func:`links` gave."""
    return F.regexp_extract(link, COMPAT_PATTERN if mode == "compat" else LINK_PATTERN, 1)


def domains(text: Column, mode: str = "strict") -> Column:
    """The domain of each link, in the order of :func:`links`."""
    return F.transform(links(text, mode), lambda link: domain_of(link, mode))

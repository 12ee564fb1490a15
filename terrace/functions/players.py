"""Names in news, what is said about them, and team sentiment of a match.

Names need positions of matches, which SQL functions don't give, so they are found in Arrow
batches; everything else is columns and joins. Null texts have no name; whole texts are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Name shapes, words that mark a player nearby, words that are no names.
FULL_NAME = r"\b([A-Z][a-z]{1,15}\s[A-Z][a-z]{1,20}(?:\s[A-Z][a-z]{1,20})?)\b"
CAPITALISED = r"\b([A-Z][a-z]{2,20})\b"
CONTEXT = ["scored", "goal", "assist", "injur", "sidelined", "ruled out", "return", "fit", "doubt", "miss", "absent", "surgery", "captain", "striker", "midfielder", "defender", "goalkeeper", "winger", "forward", "playmaker", "star"]
NO_NAMES = {
    "Premier", "League", "United", "City", "Palace", "Forest", "Villa", "Town", "Wednesday", "Saturday", "Sunday", "Monday", "Tuesday", "January",
    "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Arsenal", "Chelsea", "Liverpool",
    "Tottenham", "Newcastle", "Brighton", "Everton", "Fulham", "Brentford", "Wolves", "Bournemouth", "Ipswich", "Leicester", "Southampton", "England",
    "Spain", "France", "Germany", "Brazil", "Argentina", "Manager", "Coach", "Report", "Update", "Breaking",
}
ABSENT = ["injur", "ruled out", "sidelined", "doubt", "miss(?:es|ing)?", "absent", "out of", "surgery", "torn", "fracture", "hamstring", "knee", "ankle", "muscle", "ban", "suspend"]
BACK = ["return", r"\bfit\b", "available", "recover", "back in", "training", "ready", "passed.*test"]
NEAR, AROUND = 100, 80

_FULL, _WORD = re.compile(FULL_NAME), re.compile(CAPITALISED)
_MARKS = re.compile("(?=(" + "|".join(CONTEXT) + "))")
_ABSENT, _BACK = re.compile("|".join(ABSENT)), re.compile("|".join(BACK))
IMPACT = "players array<string>, player_injury double, player_absence double, player_return double, player_impact double"


def _lowered(text: str) -> str:
    """Lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def player_names(text: str | None) -> list[str]:
    """T4: full names, and capitalised words with a marking word within NEAR symbols; sorted,
    each once. Marks are found once for the text and looked up by place."""
    if not text:
        return []
    found = {m[1] for m in _FULL.finditer(text)}
    marks = [(m.start(1), m.end(1)) for m in _MARKS.finditer(_lowered(text))]
    starts = [a for a, _ in marks]
    ends = [*accumulate((b for _, b in reversed(marks)), min)][::-1]  # least end from each mark on
    for m in _WORD.finditer(text):
        if m[1] not in NO_NAMES and m[1] not in found:
            i = bisect_left(starts, m.start() - NEAR)
            if i < len(starts) and ends[i] <= m.end() + NEAR:
                found.add(m[1])
    return sorted(found)


def player_impact(text: str | None) -> tuple[list[str], float, float, float, float]:
    """T5: names, injury, absence, return, impact. Each name counts once by what stands around
    its first place; shares are at most 1, impact is within -1 and 1."""
    names = player_names(text)
    low = _lowered(text or "")
    out = back = 0
    for name in names:
        word = name.lower()
        at = low.find(word)
        around = low[max(0, at - AROUND) : at + len(word) + AROUND]
        out += _ABSENT.search(around) is not None
        back += _BACK.search(around) is not None
    impact = 0.3 * back - 0.7 * out
    return names, min(1.0, 0.4 * out), min(1.0, 0.3 * out), min(1.0, 0.3 * back), max(-1.0, min(1.0, impact))


def with_players(articles: DataFrame, text: str = "text") -> DataFrame:
    """articles with the columns of IMPACT."""
    added = StructType.fromDDL(IMPACT)
    at = articles.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(added)
        for batch in batches:
            found = list(zip(*(player_impact(x.as_py()) for x in batch.column(at)))) or [[]] * len(kinds)
            yield pa.record_batch([*batch.columns, *(pa.array(list(v), k.type) for v, k in zip(found, kinds))], names=[*batch.schema.names, *kinds.names])

    return articles.mapInArrow(run, StructType([*articles.schema.fields, *added.fields]))


def blended(keyword: Column, model: Column | None = None) -> Column:
    """0.7 of a model's score and 0.3 of the words', the words' alone where it is null."""
    return keyword if model is None else F.coalesce(0.7 * model + 0.3 * keyword, keyword)


def match_sentiment(matches: DataFrame, teams: DataFrame, names: list[str], differences: list[str] = (), team: str = "team", prefix: str = "live_") -> DataFrame:
    """Both teams' values, 0 where a team has none, and differences of some. teams has
    one row a team; Spark chooses by its size whether it is sent to the matches."""
    out = matches
    for side in ("home", "away"):
        look = teams.select(F.col(team).alias(f"{side}_team"), *[F.col(n).alias(f"{prefix}{n}_{side}") for n in names])
        out = out.join(look, f"{side}_team", "left")
    out = out.withColumns({f"{prefix}{n}_{s}": F.coalesce(F.col(f"{prefix}{n}_{s}"), F.lit(0)) for n in names for s in ("home", "away")})
    return out.withColumns({f"{prefix}{n}_diff": F.col(f"{prefix}{n}_home") - F.col(f"{prefix}{n}_away") for n in differences}) if differences else out


def historical_sentiment(matches: DataFrame, teams: DataFrame, form: str = "ppg_l5") -> DataFrame:
    """Sentiment, volume, consensus and injury burden of both teams, and sentiment by
    form (1.5 where there is none yet). teams: team, sentiment, volume, consensus, burden."""
    out = match_sentiment(matches, teams, ["sentiment", "volume", "consensus", "burden"], ["sentiment", "burden"], prefix="")
    return out.withColumns({f"sentiment_form_{s}": F.col(f"sentiment_{s}") * F.coalesce(F.col(f"{form}_{s}"), F.lit(1.5)) for s in ("home", "away")})

"""Parameters shared by the lead, cadence and outreach operators."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Messages and steps that have a text.  The texts are the user's: these defaults only fill in every field.
MESSAGES = "first_en first_ta followup1_en followup1_ta call_en details_en details_ta nudge_en nudge_ta has_app_en checkin3_en checkin7_en review30_en".split()
TEMPLATES = dict.fromkeys(MESSAGES, "{hello}\n{sender}, {product}: {topic}, {org}. {area_line}\n{offer} {link}")
HINTS = dict.fromkeys("first followup1 call send_details nudge_details checkin3 checkin7 review30".split(), "")


@dataclass(frozen=True)
class Settings:
    country: str = "IN"
    lang: str = "en"
    cc: str = "91"
    daily_cap: int = 15
    min_queue_score: int = 30
    places_daily_cap: int = 200
    usd_per_request: float = 0.035
    chain_words: str = ""
    sender: str = "our team"
    product: str = "our product"
    topic: str = "the topic"
    org: str = "centre"
    link: str = "https://example.com/"
    offer: str = "Two trial accounts are free."
    templates: dict = field(default_factory=lambda: dict(TEMPLATES))
    hints: dict = field(default_factory=lambda: dict(HINTS))

    @property
    def effective_daily_cap(self) -> int:
        """A configured 0 means the default cap."""
        return self.daily_cap or 15

    @property
    def effective_places_cap(self) -> int:
        return self.places_daily_cap or 200

"""Run parameters: the publishing site and the reference date.

Nothing here is read from the clock or the environment; every value that the
original tool took from a constant or ``date()`` is a field, so results are
reproducible and the same job can serve any site.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SiteConfig:
    name: str = "Example Jobs"
    url: str = "https://jobs.example.org"
    host: str = "jobs.example.org"
    # (marker searched in link urls, title, url) — appended when no link has the marker
    channels: tuple = (
        ("t.me/examplejobs", "\U0001F4E2 Telegram Channel", "https://t.me/examplejobs"),
        ("whatsapp.com/channel", "\U0001F7E2 WhatsApp Channel",
         "https://whatsapp.com/channel/example"),
    )
    as_of: str = "2026-06-15"  # stands in for "today" (yyyy-MM-dd)
    default_image: str = field(default="")

    @property
    def as_of_year(self) -> str:
        return self.as_of[:4]

    @property
    def image_fallback(self) -> str:
        return self.default_image or self.url + "/images/og-default.png"


DEFAULT_SITE = SiteConfig()

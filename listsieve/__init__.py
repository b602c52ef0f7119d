"""listsieve: triage of large listing collections as Spark DataFrame jobs."""

from listsieve.profile import Bonus, Geography, Keyword, Profile

__all__ = ["Bonus", "Geography", "Keyword", "Profile"]

"""DataFrame-to-DataFrame operators. RACE names the columns that tell races apart."""

RACE = ("race",)

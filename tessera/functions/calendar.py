"""Words of the calendar."""

#: Month words of English and Spanish, by month.
MONTHS = (
    "january jan enero ene",
    "february feb febrero",
    "march mar marzo",
    "april apr abril abr",
    "may mayo",
    "june jun junio",
    "july jul julio",
    "august aug agosto ago",
    "september sep sept septiembre setiembre",
    "october oct octubre",
    "november nov noviembre",
    "december dec diciembre dic",
)

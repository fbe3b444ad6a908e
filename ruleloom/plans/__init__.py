"""Rules: terms, atoms, text form, analysis and rewrites. Nothing here touches Spark."""

"""Step lists folded into one logical plan, and SQL over registered views."""

"""Compositions: corpora over the driver tables, the six tiers, registered queries."""

"""The registered queries over the driver's tables, and the SQL that gives the same rows."""

from loomwork.plans import assembly, cleaning, pictures, similarity

QUERIES = similarity.QUERIES | cleaning.QUERIES | assembly.QUERIES | pictures.QUERIES
ORACLES = similarity.ORACLES | cleaning.ORACLES | assembly.ORACLES | pictures.ORACLES

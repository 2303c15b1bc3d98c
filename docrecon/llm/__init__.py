"""Training-data operators over a `documents` table. Nothing outside this folder imports it."""

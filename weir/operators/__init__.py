"""The stages of a pipeline, by the name they have in its file."""

from weir.operators.dedupe import Dedupe
from weir.operators.edit import Edit
from weir.operators.sample import Sample
from weir.operators.script import Script
from weir.operators.select import Filter, Route
from weir.operators.text import Extract, Redact

STAGES = {"filter": Filter, "route": Route, "dedupe": Dedupe, "edit": Edit, "extract": Extract, "redact": Redact, "sample": Sample, "script": Script}

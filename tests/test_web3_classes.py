"""One class of Solidity matches asks for no more of the record than it looks at."""

from sourceassay.operators import corpus, signatures, solidity_index
from sourceassay.plans import demo_corpus


def test_classes_alone_and_together(spark):
    texts = ["pragma solidity ^0.7.0;\ncontract C {\n%s\n%s\n}\n}\n" % (
        header or "function f(address to, uint amount) external {", "\n".join(lines)) for header, lines in demo_corpus.SOL_SCENARIOS]
    rows = [("p", f"F{i}.sol", bytearray(t.encode()), False) for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "project string, path string, raw binary, is_symlink boolean")
    records = solidity_index.solidity_index(files)
    whole = [r for r in signatures.web3_matches(records).collect()]
    names = {r.vulnerability_class for r in whole}
    assert len(names) > 3
    for name in names:
        worth = solidity_index.sol_files(signatures.worth_recording(corpus.solidity_sources(files), name))
        assert sorted(signatures.web3_matches(worth, name).collect()) == sorted(r for r in whole if r.vulnerability_class == name)
    plan = signatures.web3_matches(records, "TX_ORIGIN_ABUSE")._jdf.queryExecution().optimizedPlan().toString()
    assert "sqrt" not in plan and "function_definition" not in plan  # neither functions nor arithmetic are worked out

"""The clause types that a service knows without a corpus at hand."""

# Names of clause types; their definitions come with the corpus (``operators.spans.parse_corpus``).
LABELS = (
    "Notice Period To Terminate Renewal", "Governing Law", "Most Favored Nation", "Non-Compete", "Exclusivity", "No-Solicit Of Customers", "Competitive Restriction Exception", "No-Solicit Of Employees",
    "Non-Disparagement", "Termination For Convenience", "Rofr/Rofo/Rofn", "Change Of Control", "Anti-Assignment", "Revenue/Profit Sharing", "Price Restrictions", "Minimum Commitment", "Volume Restriction",
    "Ip Ownership Assignment", "Joint Ip Ownership", "License Grant", "Non-Transferable License", "Affiliate License-Licensor", "Affiliate License-Licensee", "Unlimited/All-You-Can-Eat-License",
    "Irrevocable Or Perpetual License", "Source Code Escrow", "Post-Termination Services", "Audit Rights", "Uncapped Liability", "Cap On Liability", "Liquidated Damages", "Warranty Duration", "Insurance",
    "Covenant Not To Sue", "Third Party Beneficiary",
)

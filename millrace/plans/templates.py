"""Legal texts made from the order tables by expressions that Spark and other SQL engines read alike. They give the checks
something to find: the test tables hold invented prose only."""

from __future__ import annotations

#: a summary of one order as a case; k is its key
SUMMARY = """
concat(
  case when k % 11 = 0 then 'UNITED STATES DISTRICT COURT' || chr(10) when k % 11 = 1 then 'Court: Northern District' || chr(10) else '' end,
  case when k % 13 = 0 then 'IT IS SO ORDERED.' || chr(10) when k % 13 = 1 then '1 one line' || chr(10) || '2 two lines' || chr(10) || '3 three lines' || chr(10) else '' end,
  case when k % 17 = 0 then 'Here is the summary of the matter. ' else '' end,
  'Party ', cast(k as varchar(20)), ' ',
  case when k % 5 = 0 then 'sues and alleges and argues that ' when k % 5 = 1 then 'filed suit on March 3, 2010 and alleged that ' else 'brought a case and ' end,
  case when k % 7 = 0 then 'in 210 the rules changed. ' when k % 7 = 1 then 'since 20199 the rules changed. ' when k % 7 = 2 then 'in 1650 the rules changed. ' else 'the rules changed. ' end,
  case when k % 3 = 0 then 'The claim rests on Title VII and Due Process. ' else 'The claim rests on custom. ' end,
  case when k % 4 = 0 then 'The Superior Court granted damages in a class action. ' when k % 4 = 1 then 'The court denied punitive relief. ' else 'Nothing was done about it so far. ' end,
  case when k % 19 = 0 then 'The final judgement used the token 2oo4 and 12ab. ' else '' end,
  case when k % 23 = 0 then 'A B CD EF GH IJ KL MN went on. ' else '' end,
  case when k % 29 = 0 then 'This sentence is here a second time to be found by the check. This sentence is here a second time to be found by the check. ' else '' end,
  case when k % 31 = 0 then 'It went on and on and on and on and on and on and on and on and on and on and on and on and on and on and on and on and on' else 'The matter was closed in good order' end,
  case when k % 6 = 0 then '' when k % 6 = 1 then '...' else '.' end)
"""

#: title and type of a document that stands for an order line; n is its number in the order, p its part
TITLE = """
case p % 12 when 0 then 'Opinion' when 1 then 'Amended Complaint' when 2 then 'Motion to Dismiss' when 3 then 'Docket (PACER)' when 4 then 'Reply brief' when 5 then 'Consent Decree'
  when 6 then 'Press release' when 7 then 'Notice of appeal' when 8 then 'Motion for summary judgment' when 9 then 'Class cert papers' when 10 then '' else 'Exhibit list' end
"""
KIND = "case when n % 3 = 0 then 'Order/Opinion' when n % 3 = 1 then '' else 'Pleading' end"


def orders(view: str = "orders") -> str:
    return f"(select k, {SUMMARY} as summary from (select o_orderkey as k from {view}) as o)"

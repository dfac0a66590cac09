from quire.functions.coders import TARGET_LABELS
from quire.plans.clinical import load_cohort

PD, AP = list(TARGET_LABELS)


def test_clinical_loader(spark, tmp_path):
    (tmp_path / "enrollement.csv").write_text(
        "Project key,Enrolment Group\n"
        f"p1,\"{PD}\"\np2,\"{AP}\"\np3,HC\np1,\"{AP}\"\np4,\"{PD}\"\n")
    (tmp_path / "demographic.csv").write_text(
        "Project key,Age at study visit (automatic),Years of education,Gender,Has a regular caregiver?\n"
        "p1,70,12,Male/Masculin,Yes/Oui\np2,abc,16,Female/Féminin,No/Non\np9,1,1,Male,Yes\n")
    (tmp_path / "mbic.csv").write_text("Project key,Grand total,Completed/Rempli\np1,5,Incomplete\n")
    (tmp_path / "mbic_capri.csv").write_text("Project key,Grand total,Completed/Rempli\np4,7,Yes\n")
    (tmp_path / "mds-updrs.csv").write_text(
        "Project key,updrs_3_9,updrs_3_10,Hoehn and Yahr stage\np1,1,2,Stage 2\np2,,,\n")
    df, feats = load_cohort(spark, str(tmp_path))
    rows = {r["project_key"]: r for r in df.collect()}
    assert set(rows) == {"p1", "p2", "p4"} and rows["p1"]["y"] == 0 and rows["p2"]["y"] == 1
    assert rows["p1"]["age_at_visit"] == 70.0 and rows["p2"]["age_at_visit"] is None
    assert rows["p1"]["sex_male"] == 1.0 and rows["p2"]["sex_male"] == 0.0
    assert rows["p1"]["mbic_administered"] == 1.0 and rows["p2"]["mbic_administered"] is None
    assert rows["p4"]["mbic_grand_total"] is None          # second cohort file adds no column (first table wins)
    assert rows["p1"]["updrs_axial_score"] == 3.0 and rows["p2"]["updrs_axial_score"] is None
    assert rows["p1"]["updrs_hoehn_yahr"] == 2.0
    assert "moca_total" not in feats                        # absent instrument, all-null feature dropped
    df2, _ = load_cohort(spark, str(tmp_path), on_conflict="coalesce")
    assert {r["project_key"]: r for r in df2.collect()}["p4"]["mbic_grand_total"] == 7.0
